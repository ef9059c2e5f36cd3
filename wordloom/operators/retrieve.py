"""Retrieval of the best matching passage by rarity of shared words, and alignment of the pair."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.session import materialise


#: The part of a query's summed rarity that its rarest words make up, by which rows are found first.
LEAD = 0.65


def retrieve(queries: DataFrame, rows: DataFrame, cap: int = 400, floor: float = 0.35) -> DataFrame:
    """query_id, row_id, score, coverage_ppm, accepted: each query's best row.

    queries: query_id, key; rows: row_id, key (one row a word). Words in more than `cap` rows do not score: that is
    the meaning of the measure, and it bounds the join. The score sums whole millionths of ln(N / df) over the
    query's distinct words, so no order of summing can move it; equal scores go to the lower row. Coverage counts
    all distinct words of the query, frequent ones too.

    Rows are found by a query's rarest words, and only those that the other words could still make the best are
    scored in full. A row that has none of the rarest words scores at most the others' sum; where that is not below
    the best sum found, the query is scored by all its words. So the result is that of scoring everything.
    """
    # Each side is read several times below, so both are written once.
    q = materialise(queries.where("key is not null").select("query_id", "key").distinct(), "retrieve-queries")
    r = materialise(rows.where("key is not null").select("row_id", "key").distinct(), "retrieve-rows")
    n = r.select("row_id").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    df = r.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") <= cap)
    idf = df.select("key", F.round(F.log(n / F.col("df")) * 1_000_000).cast("bigint").alias("idf"))
    own = Window.partitionBy("query_id")
    rarest = own.orderBy(F.col("idf").desc(), "key").rowsBetween(Window.unboundedPreceding, -1)
    words = q.join(idf, "key").withColumns({"total": F.sum("idf").over(own), "ahead": F.coalesce(F.sum("idf").over(rarest), F.lit(0))})
    words = materialise(words.select("query_id", "key", "idf", (F.col("ahead") < LEAD * F.col("total")).alias("lead")), "retrieve-words")
    rest = words.groupBy("query_id").agg(F.coalesce(F.sum(F.when(~F.col("lead"), F.col("idf"))), F.lit(0)).alias("rest"))
    led = words.where("lead").join(r, "key").groupBy("query_id", "row_id").agg(F.sum("idf").alias("part"))
    led = materialise(led.join(rest, "query_id").withColumn("top", F.max("part").over(own)).where(F.col("part") + F.col("rest") >= F.col("top")), "retrieve-led")
    sure = led.where(F.col("top") > F.col("rest"))
    more = sure.join(words.where("not lead").select("query_id", "key", "idf"), "query_id").join(r, ["row_id", "key"]).select("query_id", "row_id", "idf")
    scored = sure.select("query_id", "row_id", F.col("part").alias("idf")).unionByName(more)
    open_ = words.join(sure.select("query_id").distinct(), "query_id", "left_anti").join(r, "key").select("query_id", "row_id", "idf")
    scored = scored.unionByName(open_).groupBy("query_id", "row_id").agg(F.sum("idf").alias("score"))
    best = scored.groupBy("query_id").agg(F.min_by("row_id", F.struct(-F.col("score"), F.col("row_id"))).alias("row_id"), F.max("score").alias("score"))
    size = q.groupBy("query_id").agg(F.count(F.lit(1)).alias("size"))
    shared = best.join(q, "query_id").join(r, ["row_id", "key"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("shared"))
    got = best.join(size, "query_id").join(shared, "query_id")
    ppm = F.floor(F.col("shared") * 1_000_000 / F.col("size")).cast("bigint")
    return got.select("query_id", "row_id", "score", ppm.alias("coverage_ppm"), (F.col("shared") >= floor * F.col("size")).alias("accepted"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from difflib import SequenceMatcher

    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("size", pa.int32())]))
    for batch in batches:
        out = []
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            found = SequenceMatcher(None, a or [], b or [], autojunk=False).get_matching_blocks()
            out.append([{"a": m.a, "b": m.b, "size": m.size} for m in found if m.size])
        yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("row_id"), pa.array(out, kind)], names=["query_id", "row_id", "blocks"])


def align(pairs: DataFrame) -> DataFrame:
    """query_id, row_id, blocks: the longest matching blocks of the arrays a and b, the longest first and then left
    and right of it, as ARRAY<STRUCT<a, b, size>>. Null arrays match nothing."""
    return pairs.select("query_id", "row_id", "a", "b").mapInArrow(_blocks, "query_id string, row_id string, blocks array<struct<a: int, b: int, size: int>>")


def diagonal_blocks(pairs: DataFrame, least: int = 3) -> DataFrame:
    """query_id, row_id, a, b, size: every maximal run of equal words on one diagonal, of `least` words or more. A
    pair's words meet inside the pair only; texts are bounded."""
    a = pairs.select("query_id", "row_id", F.posexplode("a").alias("pa", "key"))
    b = pairs.select("query_id", "row_id", F.posexplode("b").alias("pb", "key"))
    hit = a.join(b, ["query_id", "row_id", "key"]).withColumn("d", F.col("pa") - F.col("pb"))
    w = Window.partitionBy("query_id", "row_id", "d").orderBy("pa")
    runs = hit.withColumn("g", F.col("pa") - F.row_number().over(w)).groupBy("query_id", "row_id", "d", "g")
    return runs.agg(F.min("pa").alias("a"), F.min("pb").alias("b"), F.count(F.lit(1)).alias("size")).where(F.col("size") >= least).select("query_id", "row_id", "a", "b", "size")
