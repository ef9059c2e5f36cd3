"""The queries of this subpackage."""

from wordloom.llm import encode, linkage, lookalike, mix, spam, term_counts, top_n

MODULES = [top_n, term_counts, lookalike, encode, mix, spam, linkage]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in MODULES for k, s in m.ORACLE.items()}
