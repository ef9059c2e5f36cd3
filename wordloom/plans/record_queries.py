"""Queries over records and lines, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom.operators import segment as S
from wordloom.plans.text_queries import REC, _records
from wordloom.session import table

QUERIES, ORACLE = {}, {}


def add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        ORACLE[name] = sql


_top = lambda: F.col("layer") == "heading_kitab"
_sub = lambda: F.col("layer") == "heading_bab"
_main = lambda: F.col("layer") == "matn"
_aside = lambda: F.col("layer") == "zawaid"
OVER = "OVER (PARTITION BY corpus ORDER BY seq ROWS UNBOUNDED PRECEDING)"

add(
    "hierarchy_index",
    lambda s, d: S.hierarchy(_records(s, d), "corpus", "seq", _top(), _sub(), "textraw").select("id", "top_no", "sub_no", "top_title", "sub_title"),
    f"""WITH {REC}, a AS (SELECT *, CAST(sum(CASE WHEN layer = 'heading_kitab' THEN 1 ELSE 0 END) {OVER} AS BIGINT) t, CAST(sum(CASE WHEN layer = 'heading_bab' THEN 1 ELSE 0 END) {OVER} AS BIGINT) s FROM rec),
b AS (SELECT *, CAST(sum(CASE WHEN layer = 'heading_bab' THEN 1 ELSE 0 END) OVER (PARTITION BY corpus, t ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) sn FROM a)
SELECT id, t AS top_no, sn AS sub_no, max(CASE WHEN layer = 'heading_kitab' THEN textraw END) OVER (PARTITION BY corpus, t) AS top_title,
CASE WHEN sn > 0 THEN max(CASE WHEN layer = 'heading_bab' THEN textraw END) OVER (PARTITION BY corpus, t, sn) END AS sub_title FROM b""",
)
add(
    "latch_flag",
    lambda s, d: S.latch(_records(s, d), "corpus", "seq", _aside(), "latched").select("id", "latched"),
    f"WITH {REC} SELECT id, max(CASE WHEN layer = 'zawaid' THEN 1 ELSE 0 END) {OVER} = 1 AS latched FROM rec",
)
add(
    "display_number",
    lambda s, d: S.display_numbers(_records(s, d), "corpus", "seq", _main() | _aside()).where("display_no is not null").select("id", "display_no"),
    f"WITH {REC} SELECT id, row_number() OVER (PARTITION BY corpus ORDER BY seq) AS display_no FROM rec WHERE layer IN ('matn', 'zawaid')",
)
add(
    "phantom_index",
    lambda s, d: S.phantom_index(_records(s, d), "corpus", "seq", _top(), _sub()).select("id", "phantom_no"),
    f"""WITH {REC}, g AS (SELECT id, corpus, seq, row_number() OVER w pl, CASE WHEN layer = 'heading_kitab' AND coalesce(lead(layer) OVER w, '') <> 'heading_bab' THEN 1 ELSE 0 END gh FROM rec WINDOW w AS (PARTITION BY corpus ORDER BY seq))
SELECT id, CAST(pl + coalesce(sum(gh) OVER (PARTITION BY corpus ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS phantom_no FROM g""",
)
add(
    "prev_next",
    lambda s, d: S.neighbours(_records(s, d), "corpus", "seq", "id").select("id", "before", "after"),
    f"WITH {REC} SELECT id, lag(id) OVER (PARTITION BY corpus ORDER BY seq) AS before, lead(id) OVER (PARTITION BY corpus ORDER BY seq) AS after FROM rec",
)
add(
    "asof_backward",
    lambda s, d: S.owners(_records(s, d), "corpus", "seq", "number").select("id", "owner"),
    f"WITH {REC} SELECT id, last_value(number IGNORE NULLS) {OVER} AS owner FROM rec",
)
add(
    "asof_forward",
    lambda s, d: S.owners(_records(s, d), "corpus", "seq", "number").select("id", "ahead"),
    f"WITH {REC} SELECT id, first_value(number IGNORE NULLS) OVER (PARTITION BY corpus ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead FROM rec",
)
add(
    "trailing_run",
    lambda s, d: S.trailing_runs(_records(s, d), "corpus", "seq", "id", _main(), _aside()),
    f"""WITH {REC}, a AS (SELECT *, count(CASE WHEN layer = 'matn' THEN 1 END) {OVER} g FROM rec),
b AS (SELECT *, sum(CASE WHEN layer NOT IN ('matn', 'zawaid') THEN 1 ELSE 0 END) OVER (PARTITION BY corpus, g ORDER BY seq ROWS UNBOUNDED PRECEDING) br, first_value(id) OVER (PARTITION BY corpus, g ORDER BY seq) m FROM a WHERE g > 0)
SELECT m AS main, id, row_number() OVER (PARTITION BY corpus, g ORDER BY seq) AS place FROM b WHERE layer = 'zawaid' AND br = 0""",
)
add(
    "missing_numbers",
    lambda s, d: S.missing_numbers(_records(s, d), "corpus", "number"),
    f"""WITH {REC}, e AS (SELECT corpus, min(number) lo, max(number) hi FROM rec GROUP BY corpus), r AS (SELECT corpus, unnest(range(lo, hi + 1)) number FROM e)
SELECT corpus, CAST(number AS BIGINT) AS number FROM r ANTI JOIN rec USING (corpus, number)""",
)
add(
    "layer_counts",
    lambda s, d: _records(s, d).groupBy("corpus", "layer").agg(F.count(F.lit(1)).alias("records"), F.sum("tokens").alias("tokens"), F.min_by("id", F.struct("tokens", "id")).alias("shortest"), F.max_by("id", F.struct("tokens", "id")).alias("longest")),
    f"WITH {REC} SELECT corpus, layer, count(*) AS records, CAST(sum(tokens) AS BIGINT) AS tokens, min_by(id, (tokens, id)) AS shortest, max_by(id, (tokens, id)) AS longest FROM rec GROUP BY ALL",
)
add(
    "layer_sum_check",
    lambda s, d: _records(s, d).groupBy("corpus").agg(F.sum("tokens").alias("declared"), F.sum(F.size(F.regexp_extract_all("textraw", F.lit(r"(\p{L}+)"), 1))).alias("counted")).withColumn("delta", F.col("counted") - F.col("declared")),
    rf"WITH {REC} SELECT corpus, CAST(sum(tokens) AS BIGINT) AS declared, CAST(sum(len(regexp_extract_all(textraw, '\p{{L}}+'))) AS BIGINT) AS counted, CAST(sum(len(regexp_extract_all(textraw, '\p{{L}}+'))) - sum(tokens) AS BIGINT) AS delta FROM rec GROUP BY corpus",
)
add(
    "heading_tree",
    lambda s, d: S.hierarchy(_records(s, d), "corpus", "seq", _top(), _sub(), "textraw")
    .where(_top() | _sub())
    .groupBy("corpus", "top_no")
    .agg(F.max(F.when(_top(), F.col("id"))).alias("kitab"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(_sub(), F.struct("seq", "id")))), lambda x: x["id"]), "|").alias("babs")),
    f"""WITH {REC}, a AS (SELECT *, CAST(sum(CASE WHEN layer = 'heading_kitab' THEN 1 ELSE 0 END) {OVER} AS BIGINT) t FROM rec)
SELECT corpus, t AS top_no, max(CASE WHEN layer = 'heading_kitab' THEN id END) AS kitab, coalesce(string_agg(id, '|' ORDER BY seq) FILTER (WHERE layer = 'heading_bab'), '') AS babs FROM a WHERE layer IN ('heading_kitab', 'heading_bab') GROUP BY corpus, t""",
)
add(
    "corpus_registry",
    lambda s, d: _records(s, d).groupBy("corpus").agg(F.count(F.lit(1)).alias("records"), F.max("number").alias("number_max"), F.bool_or(F.col("zawaidnote").isNotNull()).alias("has_notes")),
    f"WITH {REC} SELECT corpus, count(*) AS records, max(number) AS number_max, bool_or(zawaidnote IS NOT NULL) AS has_notes FROM rec GROUP BY corpus",
)


# Lines of documents
LINES = r"lines AS (SELECT doc_id, unnest(string_split(regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g'), chr(10))) AS value, CAST(generate_subscripts(string_split(regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g'), chr(10)), 1) - 1 AS INTEGER) AS line FROM documents)"
CONT = r"^(?:https?:|\[|<a |#|- )"
add(
    "fold_continuations",
    lambda s, d: S.fold_continuations(table(s, d, "documents"), "doc_id", "text", lambda x: x.rlike(CONT)).select("doc_id", "line", F.md5("value").alias("h")),
    f"""WITH {LINES}, g AS (SELECT *, sum(CASE WHEN regexp_matches(value, '{CONT}') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) st FROM lines)
SELECT doc_id, min(line) AS line, md5(string_agg(value, ' ' ORDER BY line)) AS h FROM g GROUP BY doc_id, st""",
)
OPEN, HEAD = r"^[0-9]+ - ", r"^(?:باب|كتاب|فضل|ذكر|بيان|ما جاء) "
add(
    "segment_records",
    lambda s, d: S.segment_records(table(s, d, "documents"), "doc_id", "text", lambda x: x.rlike(OPEN), lambda x: x.rlike(HEAD)),
    f"""WITH {LINES}, e AS (SELECT *, CASE WHEN regexp_matches(value, '{HEAD}') THEN 'heading' WHEN regexp_matches(value, '{OPEN}') THEN 'opener' END ed FROM lines),
g AS (SELECT *, count(ed) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) rec FROM e)
SELECT doc_id, rec, coalesce(min_by(ed, line), 'front') AS kind, min(line) AS first_line, count(*) AS lines, CAST(sum(length(value)) AS BIGINT) AS chars FROM g GROUP BY doc_id, rec""",
)
