"""Word statistics, inverted indexes and lookups over a token table (corpus, record_id, seq, i, key, match_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.operators.ranking import global_rank
from wordloom.operators.scan import Scan, scan


def word_stats(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """keys, freq, doc_freq, first_record. Counted in two steps, per record and then per word, so that no task holds
    a set of records; both steps combine before their shuffle."""
    per = tokens.groupBy(*keys, "record_id").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq"))
    return per.groupBy(*keys).agg(F.sum("n").alias("freq"), F.count(F.lit(1)).alias("doc_freq"), F.min_by("record_id", F.struct("seq", "record_id")).alias("first_record"))


def freq_rank(stats: DataFrame, key: str) -> DataFrame:
    """stats with rank (freq descending, ties to the lower key), share and cum_share in whole millionths, and frame."""
    ranked = global_rank(stats, [F.col("freq").desc(), F.col(key).asc()], "rank")
    ranked = scan(ranked, [], "rank", [Scan("__upto", "sum", "freq")])
    total = stats.agg(F.sum("freq").alias("t")).scalar()
    frame = F.when(F.col("rank") <= 50, "top50").when(F.col("freq") == 1, "hapax").when(F.col("freq") >= 100, "frequent").otherwise("plain")
    ppm = lambda c: F.floor(F.col(c) * 1_000_000 / total).cast("bigint")
    return ranked.withColumns({"share_ppm": ppm("freq"), "cum_ppm": ppm("__upto"), "frame": frame}).drop("__upto")


def idf_table(tokens: DataFrame, n_records: Column) -> DataFrame:
    """key, df, idf in whole millionths of ln(N / df)."""
    df = tokens.groupBy("key", "record_id").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    return df.withColumn("idf", F.round(F.log(n_records / F.col("df")) * 1_000_000).cast("bigint"))


def postings(tokens: DataFrame, cap: int) -> DataFrame:
    """key, df, records of the keys in at most `cap` records: the cap bounds each list."""
    per = tokens.select("key", "record_id").distinct()
    few = per.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") <= cap)
    return per.join(few, "key").groupBy("key", "df").agg(F.array_sort(F.collect_list("record_id")).alias("records"))


def inverted_index(tokens: DataFrame) -> DataFrame:
    """corpus, key, seq, positions, delta (seq less the key's seq before it; the first has its own seq). The lag runs
    over chunks: a key in every record is no single task."""
    rows = tokens.groupBy("corpus", "key", "seq").agg(F.array_sort(F.collect_list("i")).alias("positions"))
    got = scan(rows, ["corpus", "key"], "seq", [Scan("__before", "lag", "seq")])
    return got.withColumn("delta", F.col("seq") - F.coalesce("__before", F.lit(0))).drop("__before")


def weighted_coverage(entries: DataFrame, weight: str, fields: list[str]) -> DataFrame:
    """field, types (rows that have it), weight_with, weight_all."""
    stack = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).isNotNull().alias("has")) for f in fields]))
    rows = entries.select(F.col(weight).alias("w"), stack.alias("x")).select("w", "x.*")
    return rows.groupBy("field").agg(
        F.count_if("has").alias("types"), F.coalesce(F.sum(F.when(F.col("has"), F.col("w"))), F.lit(0)).alias("weight_with"), F.coalesce(F.sum("w"), F.lit(0)).alias("weight_all")
    )


def ambiguity(entries: DataFrame, key: str, form: str, weight: str) -> DataFrame:
    """One row: keys, keys with several forms, their weight, the weight of all, and the most-frequent ceiling (what
    always taking a key's heaviest form would get right)."""
    per = entries.groupBy(key, form).agg(F.sum(F.coalesce(F.col(weight), F.lit(0))).alias("w"))
    keys = per.groupBy(key).agg(F.count(F.lit(1)).alias("forms"), F.sum("w").alias("w"), F.max("w").alias("top"))
    many = F.col("forms") >= 2
    return keys.agg(
        F.count(F.lit(1)).alias("keys"), F.count_if(many).alias("ambiguous"), F.coalesce(F.sum(F.when(many, F.col("w"))), F.lit(0)).alias("ambiguous_weight"), F.sum("w").alias("weight"), F.sum("top").alias("ceiling")
    )


def upper_median(df: DataFrame, value: str) -> DataFrame:
    """One row: n, the element n // 2 and the element int(0.95 n) of the sorted values, the largest. Works on the
    histogram of distinct values, not on the rows."""
    hist = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    total = hist.agg(F.sum("c").alias("n")).scalar()
    cum = hist.withColumn("upto", F.sum("c").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", total)
    at = lambda q: F.min(F.when(F.col("upto") > q, F.col("v")))
    return cum.agg(F.max("n").alias("n"), at(F.floor(F.col("n") / 2)).alias("median"), at(F.floor(F.col("n") * 95 / 100)).alias("p95"), F.max("v").alias("largest"))


def majority_vote(df: DataFrame, key: str, vote: str, known: DataFrame | None = None) -> DataFrame:
    """key, winner, votes (its count), cast (all counts), basis: the vote given most often. Of several the one that the
    one-column table `known` holds, if it holds just one of them ("known"), else the lowest ("unresolved")."""
    n = df.where(F.col(vote).isNotNull() & F.col(key).isNotNull()).groupBy(key, vote).agg(F.count(F.lit(1)).alias("__n"))
    flag = F.lit(False)
    if known is not None:
        n = n.join(known.select(F.col(known.columns[0]).alias(vote)).distinct().withColumn("__known", F.lit(True)), vote, "left")
        flag = F.coalesce("__known", F.lit(False))
    n = n.withColumn("__k", flag)
    best = n.groupBy(key).agg(F.max("__n").alias("votes"), F.sum("__n").alias("cast"))
    top = n.join(best, key).where(F.col("__n") == F.col("votes")).groupBy(key, "votes", "cast").agg(F.count(F.lit(1)).alias("tied"), F.count_if("__k").alias("tied_known"), F.min(F.when(F.col("__k"), F.col(vote))).alias("of_known"), F.min(vote).alias("lowest"))
    one = F.col("tied") == 1
    basis = F.when(one & (F.col("cast") == F.col("votes")), "unanimous").when(one, "majority").when(F.col("tied_known") == 1, "known").otherwise("unresolved")
    return top.select(key, F.when(basis == "known", F.col("of_known")).otherwise(F.col("lowest")).alias("winner"), "votes", "cast", basis.alias("basis"))


def support(df: DataFrame, key: str, vote: str) -> DataFrame:
    """key, vote, support, place: how many rows stand behind each vote, the best supported first, then the lower. A
    window keeps a key's distinct votes, which fall together before it."""
    n = df.where(F.col(vote).isNotNull() & F.col(key).isNotNull()).groupBy(key, vote).agg(F.count(F.lit(1)).alias("support"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.col("support").desc(), vote)))


def first_wins(entries: DataFrame, passes: list[DataFrame]) -> DataFrame:
    """key, node of the first pass that has the key, then the lowest order: each pass has key, node, ord."""
    rows = None
    for no, p in enumerate(passes):
        one = p.select("key", "node", F.struct(F.lit(no).alias("p"), F.col("ord").alias("o"), F.col("node").alias("n")).alias("rank"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.where("key is not null and key <> ''").groupBy("key").agg(F.min_by("node", "rank").alias("node"), F.min("rank.p").alias("pass"))


def tiered_lookup(rows: DataFrame, item: str, tries: list[Column], index: list[DataFrame]) -> DataFrame:
    """item, tier, node: for each item the first of `tries` that the index of its tier knows."""
    keyed = rows.select(item, F.posexplode(F.array(*tries)).alias("tier", "key")).where("key is not null and key <> ''")
    known = None
    for no, ix in enumerate(index):
        one = ix.select(F.lit(no).alias("tier"), "key", "node")
        known = one if known is None else known.unionByName(one)
    hits = keyed.join(known, ["tier", "key"])
    return hits.groupBy(item).agg(F.min("tier").alias("tier"), F.min_by("node", F.struct("tier", "node")).alias("node"))


def stem_recover(words: DataFrame, key: str, lexicon: DataFrame, proclitics: list[str], enclitics: list[str], least: int = 2) -> DataFrame:
    """key, stem, root: the key with one of the affix pairs taken off, where the lexicon (stem, root, freq) knows what
    is left; the longest stem, then the more frequent, then the lower. A null root is no evidence, and a word never
    stands for itself.

    Columns of words that guide it, each where there is one: `before` and `after`, whether a gloss says that something
    stands before or after the stem (null: it does not say); `final`, the word's last letter as written, for a teh
    marbuta is no pronoun; `senses`, the gloss's words, of which the lexicon's `senses` must share one.
    """
    guided = [c for c in ("before", "after", "final", "senses") if c in words.columns]
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(e).alias("e")) for p in proclitics for e in enclitics if p or e]))
    cut = words.select(key, *guided, pairs.alias("a")).where(F.col(key).startswith(F.col("a.p")) & F.col(key).endswith(F.col("a.e")))
    for column, affix in (("before", "a.p"), ("after", "a.e")):
        if column in guided:
            cut = cut.where(F.col(column).isNull() | (F.col(column) == (F.col(affix) != "")))
    if "final" in guided:
        cut = cut.where(~((F.col("a.e") == "ه") & F.coalesce(F.col("final") == "ة", F.lit(False))))
    mine = ["senses"] if "senses" in guided else []
    cut = cut.select(key, *[F.col(c).alias("__mine") for c in mine], F.substring(F.col(key), F.length("a.p") + 1, F.length(key) - F.length("a.p") - F.length("a.e")).alias("stem"))
    hit = cut.where((F.length("stem") >= least) & (F.col("stem") != F.col(key))).join(lexicon.where("root is not null"), "stem")
    if mine:
        hit = hit.where(F.arrays_overlap("__mine", "senses"))
    best = F.struct(-F.length("stem"), -F.coalesce("freq", F.lit(0)), F.col("stem"), F.col("root"))
    return hit.groupBy(key).agg(F.min_by("stem", best).alias("stem"), F.min_by("root", best).alias("root"))
