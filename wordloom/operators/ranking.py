"""A total order over a whole table without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.session import materialise

_IN_PART = (1 << 33) - 1


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with `name` = 1, 2, ... in the total order given (ties need a tiebreak column in it).

    A range sort gives every row its partition and its place there; the partitions' sizes, one number each, are
    summed up before it. An empty df stays empty; a column already called `name` is replaced.
    """
    rows = df.drop(name).orderBy(*order).withColumn("__at", F.monotonically_increasing_id())
    rows = materialise(rows, "ranked")
    part = F.shiftright("__at", 33)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    # One row a partition: the running sum and the broadcast are bounded by the number of shuffle partitions.
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    at = rows.withColumn("__part", part).join(F.broadcast(before), "__part")
    return at.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit(_IN_PART)) + 1).drop("__at", "__part", "__before")
