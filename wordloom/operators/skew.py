"""Keys that hold very many rows: found exactly, and told apart from the rest without gathering their rows.

A limit in rows is absolute, so what counts as heavy does not grow with the data. The list of heavy keys may grow
with it; it is broadcast up to LIST keys. Of a longer list only the keys that each hold more than 1 / LIST of all
rows are (there are fewer than LIST of those); any other holds too few rows to weigh a shuffled join down.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.session import materialise

#: Keys (BIGINT, with their count: 16 bytes) that are broadcast at most.
LIST = 500_000
#: Buckets of the first, coarse count.
BUCKETS = 1 << 16


def heavy_keys(rows: DataFrame, key: str, most: int) -> DataFrame:
    """key, c: the values of the BIGINT column `key` in more than `most` rows. Null keys are never heavy.

    Counted by bucket first, which shuffles no more than BUCKETS rows a task; only keys of buckets beyond the limit
    are counted one by one, partial counts before the shuffle.
    """
    bucket = F.pmod(F.col(key), F.lit(BUCKETS))
    full = rows.where(F.col(key).isNotNull()).groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("b")
    some = rows.join(F.broadcast(full), bucket == F.col("b"), "left_semi")
    return some.groupBy(key).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > most)


def tag_heavy(rows: DataFrame, key: str, most: int, limit: int = LIST) -> DataFrame:
    """rows with `c`, the number of rows of their key where that is over `most`, else null."""
    heavy = materialise(heavy_keys(rows, key, most), "heavy")
    n = heavy.count()
    if n == 0:
        return rows.withColumn("c", F.lit(None).cast("bigint"))
    if n <= limit:
        return rows.join(F.broadcast(heavy), key, "left")
    share = rows.agg(F.count(F.lit(1)).alias("t")).scalar() / limit
    got = rows.join(F.broadcast(heavy.where(F.col("c") > share)), key, "left")
    others = heavy.where(F.col("c") <= share).withColumnRenamed("c", "c2")
    return got.join(others, key, "left").withColumn("c", F.coalesce("c", "c2")).drop("c2")
