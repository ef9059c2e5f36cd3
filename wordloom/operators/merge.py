"""Merging deliveries and collections; digests, shards, samples and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlay(base: DataFrame, top: DataFrame, key: str) -> DataFrame:
    """Rows of top replace rows of base whole; columns top lacks become null. Rerun with the same top: no change."""
    kept = base.join(top.select(key).distinct(), key, "left_anti")
    return kept.unionByName(top, allowMissingColumns=True)


def enrich(rows: DataFrame, key: str, donor: DataFrame, fields: list[str], label: str) -> DataFrame:
    """rows with null or empty fields filled from donor (unique by key); filled_from names the donor where any was."""
    d = donor.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    got = rows.join(d, key, "left")
    empty = lambda f: F.nullif(F.trim(F.col(f)), F.lit("")).isNull()
    took = F.lit(False)
    for f in fields:
        took = took | (empty(f) & F.col(f"__{f}").isNotNull())
    got = got.withColumn("filled_from", F.when(took, label))
    return got.withColumns({f: F.when(empty(f), F.col(f"__{f}")).otherwise(F.col(f)) for f in fields}).drop(*[f"__{f}" for f in fields])


def merge_shared(rows: DataFrame, key: str, rank: Column, identity: list[str], fields: list[str]) -> DataFrame:
    """One row a key: each field's first known value by rank. Keys whose identity fields differ are refused
    (conflict true, fields null)."""
    firsts = [F.min_by(f, F.when(F.col(f).isNotNull(), F.struct(rank, F.col(f)))).alias(f) for f in fields]
    differ = None
    for f in identity:
        one = F.coalesce(F.min(f) != F.max(f), F.lit(False))
        differ = one if differ is None else differ | one
    got = rows.where(F.col(key).isNotNull()).groupBy(key).agg(*firsts, differ.alias("conflict"))
    return got.select(key, "conflict", *[F.when(~F.col("conflict"), F.col(f)).alias(f) for f in fields])


def richest(rows: DataFrame, key: str, item: str, fields: list[str]) -> DataFrame:
    """Of each key the item with the most characters in its fields; ties to the lower item."""
    size = sum((F.coalesce(F.length(F.col(f)), F.lit(0)) for f in fields[1:]), F.coalesce(F.length(F.col(fields[0])), F.lit(0)))
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(item, F.struct(-size, F.col(item))).alias("richest"), F.max(size).alias("chars"))


def orphans(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of one side that the other lacks: key, side."""
    a, b = left.select(key).where(F.col(key).isNotNull()).distinct(), right.select(key).where(F.col(key).isNotNull()).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


#: The prime by which digests are reduced, so that a sum of any number of rows fits a BIGINT.
DIGEST_MOD = (1 << 61) - 1


def content_digest(rows: DataFrame, group: list[str], cols: list[str]) -> DataFrame:
    """Group, rows, digest: equal for equal multisets of rows in any order. A sum of 48-bit row hashes modulo a prime:
    partial sums combine, no list of rows is ever held, and the sum is a 38-digit decimal, room for 10^24 rows."""
    row = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in cols]))
    part = F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(28,0)")
    whole = F.pmod(F.sum(part), F.lit(DIGEST_MOD).cast("decimal(38,0)")).cast("bigint")
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"), whole.alias("digest"))


def shard_plan(items: DataFrame, hash_: Column, size: Column, budget: int, most: int = 1024) -> DataFrame:
    """shards (powers of two up to `most`), largest, fits, chosen (the smallest number that fits). The finest shards
    are counted once; coarser ones are their sums, for h % n follows from h % most."""
    fine = items.groupBy((hash_ % most).alias("s")).agg(F.sum(size).cast("bigint").alias("b"))
    steps = [1 << k for k in range(most.bit_length()) if 1 << k <= most]
    every = fine.select("b", "s", F.explode(F.array(*[F.lit(n) for n in steps])).alias("shards"))
    worst = every.groupBy("shards", (F.col("s") % F.col("shards")).alias("t")).agg(F.sum("b").alias("b")).groupBy("shards").agg(F.max("b").alias("largest"))
    got = worst.withColumn("fits", F.col("largest") <= budget)
    first = got.agg(F.min(F.when(F.col("fits"), F.col("shards"))).alias("n")).scalar()
    return got.withColumn("chosen", F.coalesce(F.col("shards") == first, F.lit(False)))


def hash_sample(rows: DataFrame, stratum: str, item: str, n: int, seed: str) -> DataFrame:
    """n items of each stratum in the order of md5(seed item): a sampling operator. The window keeps n rows a
    stratum before its shuffle (a group limit), so a stratum of any size costs n rows a task."""
    w = Window.partitionBy(stratum).orderBy(F.md5(F.concat(F.lit(seed), F.col(item))), F.col(item))
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson interval of k out of n, as two columns; null for n = 0."""
    p = k / n
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    den = 1 + z * z / n
    return F.when(n > 0, (mid - half) / den), F.when(n > 0, (mid + half) / den)


def weighted_estimate(strata: DataFrame, right: str, judged: str, population: str) -> DataFrame:
    """One row: estimate_ppm, the share right in the whole, each stratum's share weighted by its population; null where a
    stratum has no verdict, for it is then unknown."""
    part = F.col(right) * F.col(population) / F.nullif(F.col(judged), F.lit(0))
    known = F.count_if(F.col(judged) == 0) == 0
    return strata.agg(F.when(known, F.floor(F.sum(part) * 1_000_000 / F.sum(population)).cast("bigint")).alias("estimate_ppm"))


def trim_payload(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of a whitelist, in its order; one that rows lack is an error, not a gap."""
    if lost := [c for c in keep if c not in rows.columns]:
        raise ValueError(f"the payload lacks {lost}")
    return rows.select(*keep)


def carry(rows: DataFrame, carried: list[str], refused: list[str]) -> DataFrame:
    """rows with the carried columns; each column must be on one list. A column on both or on none is an error, so that
    a delivery's new column is decided on before it travels."""
    if both := set(carried) & set(refused):
        raise ValueError(f"carried and refused: {sorted(both)}")
    if stray := [c for c in rows.columns if c not in {*carried, *refused}]:
        raise ValueError(f"neither carried nor refused: {stray}")
    return trim_payload(rows, carried)


def rebuild(previous: DataFrame, built: DataFrame, collection: str, key: str) -> DataFrame:
    """What was built before, with the collections that were built anew in place of their old rows: rows of other
    collections are carried forward, unless a new row has their key. The same build again changes nothing."""
    gone = previous.join(built.select(collection).distinct(), collection, "left_anti").join(built.select(key).distinct(), key, "left_anti")
    return gone.unionByName(built, allowMissingColumns=True)


def override_by_context(tokens: DataFrame, context: DataFrame, shape: Column) -> DataFrame:
    """tokens (record_id, i, root) with what an analysis in context (record_id, i, context_root) says of the root,
    where the two roots' shapes allow it; basis tells which it is."""
    got = tokens.join(context, ["record_id", "i"], "left")
    take = F.col("context_root").isNotNull() & F.coalesce(shape, F.lit(False))
    return got.withColumns({"basis": F.when(take, "context").when(F.col("root").isNotNull(), "entry"), "root": F.when(take, F.col("context_root")).otherwise(F.col("root"))}).drop("context_root")


def drift(measured: DataFrame, expected: DataFrame, key: str, value: str, tolerance: Column | int = 0) -> DataFrame:
    """key, measured, expected, state (ok, drift, unexpected, missing) of measures against a table of expectations."""
    a, b = measured.select(key, F.col(value).alias("measured")), expected.where(F.col(value).isNotNull()).select(key, F.col(value).alias("expected"))
    tol = tolerance if isinstance(tolerance, Column) else F.lit(tolerance)
    state = F.when(F.col("expected").isNull(), "unexpected").when(F.col("measured").isNull(), "missing").when(F.abs(F.col("measured") - F.col("expected")) <= tol, "ok").otherwise("drift")
    return a.join(b, key, "full_outer").withColumn("state", state)
