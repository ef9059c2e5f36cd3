"""Running values in an order, without one task a group: prefix scans over range-partitioned chunks.

A window partitioned by a collection puts the whole collection into one task. Here rows are range-partitioned by
(group, order), so a group of any size is spread over chunks; windows run inside chunks, and what a chunk hands on
(its sums, its first and last values) is carried over a table of one row a (group, chunk).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.session import materialise


@dataclass(frozen=True)
class Scan:
    """One output column. kind: sum (of all rows up to this one), last (last value known up to this row), next
    (first known from this row on), lag and lead (the neighbouring row's value, null at the ends)."""

    name: str
    kind: str
    col: str


def scan(df: DataFrame, group: list[str], order: str, outs: list[Scan]) -> DataFrame:
    """df with the outputs. `order` must be unique within a group and not null (other rows' places would be chance).

    Nulls count as 0 in sums and are skipped by last and next; lag and lead give them as they are. Null group
    values form a group. An empty df stays empty; columns called like an output are replaced by it at the end.
    """
    keys = [*group, order]
    cols = sorted({o.col for o in outs})
    rows = df.repartitionByRange(*keys).withColumn("__chunk", F.spark_partition_id())
    rows = materialise(rows, "scan")
    inside = Window.partitionBy(*group, "__chunk").orderBy(order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = inside.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # What each chunk hands on. Structs keep a null value of the edge row apart from a missing edge.
    hand = rows.groupBy(*group, "__chunk").agg(
        *[F.sum(F.coalesce(F.col(c).cast("bigint"), F.lit(0))).alias(f"__sum_{c}") for c in {o.col for o in outs if o.kind == "sum"}],
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"__last_{c}") for c in {o.col for o in outs if o.kind == "last"}],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"__next_{c}") for c in {o.col for o in outs if o.kind == "next"}],
        *[F.max_by(F.struct(c), F.col(order)).alias(f"__lag_{c}") for c in {o.col for o in outs if o.kind == "lag"}],
        *[F.min_by(F.struct(c), F.col(order)).alias(f"__lead_{c}") for c in {o.col for o in outs if o.kind == "lead"}],
    )
    chunks = Window.partitionBy(*group).orderBy("__chunk")
    before = chunks.rowsBetween(Window.unboundedPreceding, -1)
    behind = chunks.rowsBetween(1, Window.unboundedFollowing)
    carried = []
    for o in outs:
        given = f"__{o.kind}_{o.col}"
        value = {
            "sum": lambda: F.coalesce(F.sum(given).over(before), F.lit(0)),
            "last": lambda: F.last(given, ignorenulls=True).over(before),
            "next": lambda: F.first(given, ignorenulls=True).over(behind),
            "lag": lambda: F.lag(given).over(chunks)[o.col],
            "lead": lambda: F.lead(given).over(chunks)[o.col],
        }[o.kind]()
        carried.append(value.alias(f"__in_{o.name}"))
    hand = hand.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__chunk").alias("__c"), *carried)
    local = []
    for o in outs:
        value = {
            "sum": lambda: F.sum(F.coalesce(F.col(o.col).cast("bigint"), F.lit(0))).over(upto),
            "last": lambda: F.last(o.col, ignorenulls=True).over(upto),
            "next": lambda: F.first(o.col, ignorenulls=True).over(after),
            "lag": lambda: F.lag(o.col).over(inside),
            "lead": lambda: F.lead(o.col).over(inside),
        }[o.kind]()
        local.append(value.alias(f"__own_{o.name}"))
    edge_first = (F.row_number().over(inside) == 1).alias("__first")
    edge_last = F.lead(F.lit(1)).over(inside).isNull().alias("__final")
    got = rows.select("*", *local, edge_first, edge_last)
    same = F.col("__chunk") == F.col("__c")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    got = got.join(hand, same, "left")
    final = {}
    for o in outs:
        own, carry = F.col(f"__own_{o.name}"), F.col(f"__in_{o.name}")
        final[o.name] = {
            "sum": lambda: own + carry,
            "last": lambda: F.coalesce(own, carry),
            "next": lambda: F.coalesce(own, carry),
            "lag": lambda: F.when(F.col("__first"), carry).otherwise(own),
            "lead": lambda: F.when(F.col("__final"), carry).otherwise(own),
        }[o.kind]()
    kept = [c for c in df.columns if c not in final]
    return got.select(*kept, *[v.alias(n) for n, v in final.items()])
