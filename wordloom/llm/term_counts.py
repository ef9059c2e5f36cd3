"""Problem 4: occurrences and records of every distinct term, by last-seen counters.

Tokens are hash-partitioned and pass in the order of term and record. A term's counter holds three things: its
occurrences, its records, and the last record it was seen in; a token counts a new record only when that last record
differs, so no set of records a term is ever held. The counter outlives Arrow's batches. Tokens of one term in one
record always meet in one partition, those of other records may lie elsewhere: a term that makes up a third of all
tokens is spread over all partitions, and its counters, one row a partition, are added up by a hash shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.operators.ranking import global_rank
from wordloom.session import latest_by, materialise, table

RARE_RECORDS = 1
COMMON_SHARE = (1, 5)  # a term is common in at least one record of five


def _changes(values: pa.Array, last: pa.Scalar | None) -> np.ndarray:
    """Whether each value differs from the one before it, the first from `last`."""
    first = last is None or values[0].as_py() != last.as_py()
    rest = pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)
    return np.r_[first, rest].astype(bool)


def _counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, record) in the order of both, to (term, freq, doc_freq) of the partition."""
    term = record = None  # the open counter's term and the last record it was seen in ...
    freq = docs = 0  # ... its occurrences and records

    def rows(terms: list, freqs: list, doc_freqs: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array(terms, pa.string()), pa.array(freqs, pa.int64()), pa.array(doc_freqs, pa.int64())], names=["term", "freq", "doc_freq"])

    for batch in batches:
        terms, records = batch.column(0), batch.column(1)
        if len(terms) == 0:
            continue
        new = _changes(terms, term)
        unseen = new | _changes(records, record)
        starts = np.flatnonzero(np.r_[True, new[1:]])
        n, d = np.diff(np.r_[starts, len(terms)]), np.add.reduceat(unseen.astype("int64"), starts)
        if not new[0]:
            n[0], d[0] = n[0] + freq, d[0] + docs
        elif term is not None:
            yield rows([term.as_py()], [freq], [docs])
        if len(starts) > 1:
            yield rows(terms.take(pa.array(starts[:-1])), n[:-1], d[:-1])
        term, record, freq, docs = terms[-1], records[-1], int(n[-1]), int(d[-1])
    if term is not None:
        yield rows([term.as_py()], [freq], [docs])


def term_counts(df: DataFrame, term: str, record: str) -> DataFrame:
    """Columns term, freq, doc_freq over df, one row a token: its term and the record it stands in, in any order.

    Rows with a null term or record are not counted; the empty string is a term like any other. An empty df gives no
    rows; other columns are never read.
    """
    tokens = df.select(F.col(term).cast("string").alias("term"), F.col(record).cast("string").alias("record")).dropna()
    ordered = tokens.repartition("term", "record").sortWithinPartitions("term", "record")
    parts = ordered.mapInArrow(_counters, "term string, freq bigint, doc_freq bigint")
    return parts.groupBy("term").agg(F.sum("freq").alias("freq"), F.sum("doc_freq").alias("doc_freq"))


def mark_terms(counts: DataFrame, n_records: F.Column, rare: int = RARE_RECORDS, common: tuple[int, int] = COMMON_SHARE) -> DataFrame:
    """counts with `mark`: rare up to `rare` records, common from the share a/b of n_records on, else null.
    The comparison is in whole numbers. With so few records that both hold, a term is rare."""
    a, b = common
    mark = F.when(F.col("doc_freq") <= rare, "rare").when(F.col("doc_freq") * b >= n_records * a, "common")
    return counts.withColumn("mark", mark)


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """match_id, freq, doc_freq, mark of every matchid used in bindings; of a record_id the latest row counts."""
    ids = F.transform("tokens", lambda t: t["matchid"]).alias("terms")
    src = table(spark, sf_dir, "bindings").select("record_id", "loaded_at", ids)
    records = materialise(latest_by(src, ["record_id"], "loaded_at", ["terms"]), "p4-records")
    total = records.agg(F.count(F.lit(1)).alias("n")).scalar()
    tokens = records.select("record_id", F.explode("terms").alias("term"))
    return mark_terms(term_counts(tokens, "term", "record_id"), total).withColumnRenamed("term", "match_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms too rare or too common, with their mark."""
    return p4_counts(spark, sf_dir).where(F.col("mark").isNotNull()).select("match_id", "mark")


def p4_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All terms with freq, doc_freq, rank (by freq, ties to the lower id) and mark."""
    return global_rank(p4_counts(spark, sf_dir), [F.col("freq").desc(), F.col("match_id").asc()], "rank")


_BASE = """
WITH r AS (SELECT record_id, tokens FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY loaded_at DESC NULLS LAST) rn FROM bindings WHERE record_id IS NOT NULL) WHERE rn = 1),
t AS (SELECT record_id, unnest(tokens).matchid AS match_id FROM r),
c AS (SELECT match_id, count(*) freq, count(DISTINCT record_id) doc_freq FROM t WHERE match_id IS NOT NULL GROUP BY 1),
m AS (SELECT *, CASE WHEN doc_freq = 1 THEN 'rare' WHEN doc_freq * 5 >= (SELECT count(*) FROM r) THEN 'common' END AS mark FROM c)
"""
QUERIES = {"p4_found": p4_found, "p4_terms": p4_terms}
ORACLE = {
    "p4_found": _BASE + "SELECT match_id, mark FROM m WHERE mark IS NOT NULL",
    "p4_terms": _BASE + "SELECT match_id, freq, doc_freq, mark, row_number() OVER (ORDER BY freq DESC, match_id) AS rank FROM m",
}
