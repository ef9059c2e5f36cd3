"""Word statistics kept up to date from a stream of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wordloom.functions import text as X


def token_stream(records: DataFrame, key: str = "id", text: str = "textraw", time: str = "loaded_at", late: str | None = None) -> DataFrame:
    """record, time, version (hash of the text), pos, word of each delivery of a record; a text without words gives one
    row with a null word. Nothing is dropped, however late: append_batches() and totals() count a record once, by its
    latest delivery. With `late`, as windowed_counts() needs it, a record delivered again within `late` is dropped by
    its key, and the watermark bounds the state but drops what comes later than that."""
    timed = records.withColumn(time, F.col(time).cast("timestamp")).where(F.col(key).isNotNull())
    if late is not None:
        timed = timed.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    words = F.transform(X.tokens_of(text), lambda t: X.fold_key(t["raw"]))
    return timed.select(F.col(key).alias("record"), F.col(time).alias("time"), F.xxhash64(text).alias("version"), F.posexplode_outer(words).alias("pos", "word"))


def windowed_counts(tokens: DataFrame, span: str = "7 days") -> DataFrame:
    """Counts of words by time window, final once the watermark has passed it."""
    return tokens.where("word is not null").groupBy(F.window("time", span), "word").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "word", "n")


def append_batches(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each delivery's counts of a micro-batch into their own folder, batch=N, which a replayed batch overwrites:
    exactly once, and no read-modify-write of the whole table. totals() adds them up."""

    def write(batch: DataFrame, no: int) -> None:
        once = batch.select("record", "time", "version", "pos", "word").distinct()
        once.groupBy("record", "time", "version", "word").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/batch={no}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(df: DataFrame) -> DataFrame:
    """word, freq, doc_freq over all batches: of a record its latest delivery, a null time being the earliest; the same
    delivery in several batches counts once."""
    once = df.select("record", "time", "version", "word", "n").distinct()
    last = once.groupBy("record").agg(F.max(F.struct("time", "version")).alias("last"))
    kept = once.join(last, "record").where(F.col("time").eqNullSafe(F.col("last.time")) & (F.col("version") == F.col("last.version")))
    return kept.where("word is not null").groupBy("word").agg(F.sum("n").alias("freq"), F.count(F.lit(1)).alias("doc_freq"))
