"""Scans of raw deliveries and sinks of built tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_files(spark: SparkSession, path: str, sentinel: str = "#META#Header#End#") -> DataFrame:
    """Marked-up text files cut at the sentinel: path, header, body; a file without it has a null body, for the
    caller to refuse. One row a file: such a file is one book."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    cut = F.instr("value", sentinel)
    return whole.select(
        "path",
        F.when(cut > 0, F.substring(F.col("value"), F.lit(1), cut - 1)).alias("header"),
        F.when(cut > 0, F.substring(F.col("value"), cut + len(sentinel), F.length("value"))).alias("body"),
    )


def header_fields(df: DataFrame, key: str, header: str, placeholders: tuple[str, ...] = ("NODATA", "")) -> DataFrame:
    """key, field, value of header lines "#META# field :: value"; placeholder values are left out, of a repeated field
    the last line counts."""
    lines = df.select(key, F.posexplode(F.split(header, "\r?\n")).alias("n", "line"))
    pat = r"^#META#\s*(.*?)\s*::\s*(.*?)\s*$"
    got = lines.where(F.col("line").rlike(pat)).select(key, "n", F.regexp_extract("line", pat, 1).alias("field"), F.regexp_extract("line", pat, 2).alias("value"))
    return got.where(~F.col("value").isin(*placeholders)).groupBy(key, "field").agg(F.max_by("value", "n").alias("value"))


def json_units(spark: SparkSession, path: str, array: str = "hadiths", text: str = "arabic", order: str = "id") -> DataFrame:
    """Units of JSON files that hold an array, bare or under a key: unit_no, text, line (the line grammar's opener,
    "number - text"); blank texts are left out. The files are read as VARIANT, so an array and an object of arrays go
    through one reader."""
    raw = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    items = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.try_variant_get("v", f"$.{array}", "array<variant>"))
    rows = raw.select(F.explode(items).alias("u")).select(F.try_variant_get("u", f"$.{order}", "bigint").alias("unit_no"), F.try_variant_get("u", f"$.{text}", "string").alias("text"))
    rows = rows.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    return rows.withColumn("line", F.concat_ws(" - ", F.col("unit_no").cast("string"), F.trim(F.regexp_replace("text", r"\s+", " "))))


def witness_units(spark: SparkSession, path: str) -> DataFrame:
    """unit_no, text of a witness edition: the first column of CSV files with a header, numbered from 0 by file and
    row, or JSON units. A multi-line CSV file is never split, so a row's place in its file does not hang on splits."""
    if path.rstrip("/").endswith(".json"):
        return json_units(spark, path).select("unit_no", "text")
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    first = rows.columns[0]
    placed = rows.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), F.col(f"`{first}`").alias("text"))
    # One row a file: the rows before it, by the order of the files' names.
    files = placed.groupBy("file").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    files = files.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(files, "file").select((F.col("before") + F.col("at") - F.col("first")).alias("unit_no"), "text").where(F.trim(F.coalesce("text", F.lit(""))) != "")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """file (below a folder its path there, else its name), bytes, sha256 of every file under path; contents are hashed by the
    executors and never returned."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = path.rstrip("/") + "/"
    file = F.when(F.col("path").contains(root), F.substring_index("path", root, -1)).otherwise(F.regexp_extract("path", r"([^/]+)$", 1))
    return files.select(file.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """file, state of every file that is new, gone or changed against an earlier manifest; none means the inputs stand."""
    a, b = now.select("file", F.col("sha256").alias("a")), before.select("file", F.col("sha256").alias("b"))
    both = a.join(b, "file", "full_outer")
    state = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "gone").when(F.col("a") != F.col("b"), "changed")
    return both.select("file", state.alias("state")).where("state is not null")


def write_shards(df: DataFrame, path: str, shard: str, fmt: str = "json", codec: str = "gzip", parts: int = 1) -> None:
    """One folder a shard, its rows in `parts` files, written by as many tasks; only the shards that df has are
    replaced, so that a collection can be rebuilt alone."""
    salt = F.pmod(F.xxhash64(*[c for c in df.columns if c != shard]), F.lit(parts))
    out = df.repartition(F.col(shard), salt)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(shard).option("compression", codec).format(fmt).save(path)


def shard_sizes(spark: SparkSession, path: str, shard: str) -> DataFrame:
    """shard, files, bytes of what write_shards() left; the files' contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    name = F.regexp_extract("path", rf"/{shard}=([^/]*)/", 1)
    return files.groupBy(name.alias(shard)).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def nested_records(tokens: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """One row a record with its tokens as an ordered array of structs: the per-record document."""
    return tokens.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("tokens"))


def check_contract(df: DataFrame, contract: T.StructType) -> list[str]:
    """What separates df's schema from the contract: missing, extra or differently typed columns; empty when equal."""
    have, want = {f.name: f.dataType for f in df.schema.fields}, {f.name: f.dataType for f in contract.fields}
    return (
        [f"missing {n}" for n in want if n not in have]
        + [f"extra {n}" for n in have if n not in want]
        + [f"{n} is {have[n].simpleString()}, not {want[n].simpleString()}" for n in want if n in have and have[n] != want[n]]
    )
