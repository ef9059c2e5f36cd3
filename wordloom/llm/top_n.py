"""Problem 1: the N highest-scoring items of every group, by a hot-cold split.

Exact group counts part the groups. Light groups go through an ordinary window. A heavy group is salted into
cells of bounded size, the cells are range-partitioned and sorted, each keeps its first N, and a last window
over N rows a cell picks the group's N. Both parts are exact; their union is the result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.operators.skew import LIST, tag_heavy
from wordloom.session import latest_by, materialise, table

#: A group is heavy beyond this many rows, whatever the size of the data; a cell of it holds about as many.
HEAVY_ROWS = 10_000


def top_n_per_group(df: DataFrame, group: str, score: str, item: str, n: int, heavy_rows: int = HEAVY_ROWS, listed: int = LIST) -> DataFrame:
    """Columns group, place (1..n), item: the n rows of each group with the highest score, ties to the lower item.

    Rows with a null group, score or item drop out. Equal rows are counted as often as they come (a caller who
    wants an item once passes distinct items). Groups of fewer than n rows keep all; an empty df gives no rows;
    columns other than the three are never read, so their names cannot clash. The list of heavy groups is broadcast
    up to `listed` groups; of a longer one the heaviest are, and the others joined by a shuffle.
    """
    if n < 1 or not math.isfinite(n):
        raise ValueError("n must be a positive number")
    rows = df.select(F.col(group).alias("g"), F.col(score).alias("s"), F.col(item).alias("i")).dropna()
    # The row's own number is its salt: equal rows, however many, do not meet in one cell.
    rows = materialise(rows.select("g", "s", "i", F.xxhash64("g").alias("h"), F.monotonically_increasing_id().alias("no")), "topn-rows")
    order = [F.col("s").desc(), F.col("i").asc()]

    # Groups meet by a 64-bit hash: a light group that shares a heavy one's hash is merely salted too.
    marked = tag_heavy(rows, "h", heavy_rows, listed)
    whole = Window.partitionBy("g").orderBy(*order)
    light = marked.where(F.col("c").isNull()).select("g", "s", "i").withColumn("place", F.row_number().over(whole)).where(F.col("place") <= n)

    cells = F.ceil(F.col("c") / heavy_rows)
    salted = marked.where(F.col("c").isNotNull()).select("g", "s", "i", F.pmod("no", cells).alias("cell"))
    # Range partitions on (group, cell) keep a cell whole, so the window below needs no further shuffle.
    parts = salted.repartitionByRange("g", "cell")
    in_cell = Window.partitionBy("g", "cell").orderBy(*order)
    best = parts.withColumn("r", F.row_number().over(in_cell)).where(F.col("r") <= n).select("g", "s", "i")
    hot = best.withColumn("place", F.row_number().over(whole)).where(F.col("place") <= n)
    out = light.unionByName(hot)
    return out.select(F.col("g").alias(group), F.col("place").cast("int").alias("place"), F.col("i").alias(item))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three entries of the highest freq of each search_key of surface.

    A match_id counts once, with its row of the latest loaded_at (a match_id in two search_keys counts where
    that row has it); then rows without freq or search_key drop out.
    """
    rows = latest_by(table(spark, sf_dir, "surface"), ["match_id"], "loaded_at", ["search_key", "freq"])
    return top_n_per_group(rows, "search_key", "freq", "match_id", 3)


QUERIES = {"p1_found": p1_found}
ORACLE = {
    "p1_found": """
WITH l AS (SELECT match_id, search_key, freq FROM (
  SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY loaded_at DESC NULLS LAST) rn FROM surface WHERE match_id IS NOT NULL) WHERE rn = 1)
SELECT search_key, CAST(place AS INTEGER) AS place, match_id FROM (
  SELECT search_key, match_id, row_number() OVER (PARTITION BY search_key ORDER BY freq DESC, match_id) place
  FROM l WHERE freq IS NOT NULL AND search_key IS NOT NULL) WHERE place <= 3
"""
}
