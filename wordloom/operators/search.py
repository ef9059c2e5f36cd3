"""Full-text search over the token table and keyword-in-context windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.profiles import ARABIC, Profile


def search_form(tokens: DataFrame, terms: list[str], limit: int = 40) -> DataFrame:
    """The records that hold the most of the distinct terms, in reading order, the first `limit`, with the total: a
    top-k report. No term, no hit: no rows."""
    hits = tokens.where(F.col("key").isin(*dict.fromkeys(terms))).groupBy("record_id").agg(F.min("seq").alias("seq"), F.count_distinct("key").alias("matched"), F.min("i").alias("first_i"))
    best = hits.agg(F.max("matched").alias("m")).scalar()
    kept = hits.where(F.col("matched") == best)
    total = kept.agg(F.count(F.lit(1)).alias("n")).scalar()
    return kept.withColumn("total", total).orderBy("seq", "record_id").limit(limit)


def search_root(tokens: DataFrame, root: str, limit: int = 40) -> DataFrame:
    """The records with a token of the root (column root), in reading order, the first `limit`, with the total."""
    hits = tokens.where(F.col("root") == root).groupBy("record_id").agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("tokens"), F.min("i").alias("first_i"))
    total = hits.agg(F.count(F.lit(1)).alias("n")).scalar()
    return hits.withColumn("total", total).orderBy("seq", "record_id").limit(limit)


def occurrences(tokens: DataFrame, match_id: str, skip: tuple[str, int] | None = None, limit: int = 24) -> DataFrame:
    """Where a reading occurs, without the token `skip`, in reading order, the first `limit`."""
    hits = tokens.where(F.col("match_id") == match_id)
    if skip:
        hits = hits.where(~((F.col("record_id") == skip[0]) & (F.col("i") == skip[1])))
    return hits.select("record_id", "seq", "i").orderBy("seq", "record_id", "i").limit(limit)


def kwic(records: DataFrame, words: str, hit: Column, k: int) -> DataFrame:
    """record_id, i, before, word, after, cut_before, cut_after: every word for which `hit` (a function of the word,
    given as a lambda) holds, with k words on either side. The context is sliced from the record's own array, so a
    word that is everywhere costs no shuffle."""
    at = F.posexplode(F.col(words)).alias("i", "word")
    rows = records.select("record_id", words, at).where(hit)
    lo = F.greatest(F.col("i") - k, F.lit(0))
    return rows.select(
        "record_id", "i", "word",
        F.array_join(F.slice(words, lo + 1, F.col("i") - lo), " ").alias("before"),
        F.array_join(F.slice(words, F.col("i") + 2, F.lit(k)), " ").alias("after"),
        (lo > 0).alias("cut_before"),
        (F.col("i") + k + 1 < F.size(words)).alias("cut_after"),
    )


def quote_depth(df: DataFrame, key: str, text: str, opens: str = "«({", closes: str = "»)}") -> DataFrame:
    """key, n (the bracket's place), mark, depth after it; a closing bracket without an opening one leaves 0.

    The floored sum is the plain one less its least prefix, so it needs no step-by-step state; it runs inside one
    text.
    """
    marks = df.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(f"([{opens}{closes}])"), 1)).alias("n", "mark"))
    w = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.lit(opens).contains(F.col("mark")), 1).otherwise(-1)
    s = marks.withColumn("s", F.sum(step).over(w))
    return s.withColumn("depth", (F.col("s") - F.least(F.lit(0), F.min("s").over(w))).cast("bigint")).drop("s")


def quoted_words(df: DataFrame, key: str, text: str, opens: str = "«({", closes: str = "»)}", p: Profile = ARABIC) -> DataFrame:
    """key, i, word, inside: whether a word begins inside quotation. The depth is that of quote_depth(), which a word
    takes over as it stands before it."""
    item = f"([{opens}{closes}]|[{p.letters}{p.strip}]+)"
    items = df.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(item), 1)).alias("n", "item"))
    w = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.lit(opens).contains(F.col("item")), 1).when(F.lit(closes).contains(F.col("item")), -1)
    s = items.withColumns({"s": F.coalesce(F.sum(step).over(w), F.lit(0)), "step": step})
    depth = F.col("s") - F.least(F.lit(0), F.min("s").over(w))
    i = F.count_if(F.col("step").isNull()).over(w) - 1
    got = s.withColumns({"inside": depth > 0, "i": i.cast("int")})
    return got.where("step is null").select(key, "i", F.col("item").alias("word"), "inside")
