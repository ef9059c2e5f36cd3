"""Problem 3: entities matched across sources without keys, by collective graph linkage.

1. Candidate graph. Equal texts of a table are one node. Nodes meet over shared runs of three words (folded), weighted
   by their rarity. A run that leads to at most BOUND pairs, counted on both sides, makes edges; one that leads to more
   is lengthened to four, six and twelve words at its place for their weight, and its pairs are all looked at: its nodes
   are dealt into cells, and a pair whose words, in whatever order, can be aligned to COVER_NEAR is a candidate. So no
   pair that shares a run of three words is lost for the number of others that share it.
2. Meta-blocking. An edge stays when it is at least as heavy as the average edge of its row; edges between nodes that
   claim the same place, and the candidates of runs beyond BOUND, stay too.
3. Collective refinement. The words of the ends are aligned (longest common subsequence), and nodes open into their
   rows: all pairs up to BOUND; of a text with more copies than that by the place they claim, under a key of more than
   BOUND pairs the lowest id. A pair's confidence adds what its neighbours say:
   how much of the confidence around the record lies on pairs whose numbers are shifted alike. Confidences change
   their neighbours', so this repeats until no row's best partner moves. A partner once left is not taken again, so
   the rounds come to an end without a limit on their number.

A pair that has no run of three words in common is not found.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.operators.skew import tag_heavy
from wordloom.session import latest_by, materialise, table

log = logging.getLogger(__name__)

#: Pairs that one attribute may lead to without a look at their words.
BOUND = 4096
#: Nodes of a side in a cell of a run beyond BOUND, and places that words are counted at.
CELL, BUCKETS = 2048, 1024
#: Rows of one attribute beyond which they are never gathered, whatever pairs they might make.
CROWD = 100_000
#: Words of an attribute, level by level.
RUNS = (3, 4, 6, 12)
#: Numbers that make up one neighbourhood, and how far two rows' shifts may differ to agree.
NEAR, AGREE = 24, 3
#: Weights of the alignment, the neighbours' vote and the chapter in a pair's score.
W_TEXT, W_NEAR, W_CHAPTER = 0.6, 0.25, 0.15
#: Least share of the shorter text's words that the alignment must hold: on the text's word alone, and where most
#: neighbours vote for the pair.
COVER, COVER_NEAR = 0.62, 0.5
#: Records this close in order may run together in one row.
NEXT = 3

# Letters folded for comparison, and what they become.
_FROM, _TO = "أإآٱةىیئکەؤ", "ااااهيييكهو"


def words_of(text: Column) -> Column:
    """The words of a text without marks and unseen characters, letters folded; null for a null text."""
    bare = F.regexp_replace(text, r"[\p{Mn}\p{Cf}ـ]", "")
    return F.regexp_extract_all(F.lower(F.translate(bare, _FROM, _TO)), F.lit(r"(\p{L}+)"), 1)


def _rows_of(d: DataFrame, *more: str) -> DataFrame:
    """id, `more`, number, chapter (folded), h1 and h2 (128 bits that stand for the text) and codes (a hash a word) of
    the rows that have an id and a word."""
    fold = F.array_join(words_of(F.col("chapter")), " ")
    d = d.where("id is not null").select("id", *more, F.col("number").cast("int").alias("number"), F.nullif(fold, F.lit("")).alias("chapter"), words_of(F.col("text")).alias("words"))
    codes = F.transform("words", lambda x: F.xxhash64(x))
    return d.where(F.size("words") > 0).select("id", *more, "number", "chapter", F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(7), "words").alias("h2"), codes.alias("codes"))


def _nodes(rows: DataFrame, mine: bool) -> DataFrame:
    """c (a number), mine, h1, h2, n (words), codes, m (rows), lo and hi (their numbers): one a distinct text."""
    each = rows.groupBy("h1", "h2").agg(F.first("codes").alias("codes"), F.count(F.lit(1)).alias("m"), F.min("number").alias("lo"), F.max("number").alias("hi"))
    c = F.monotonically_increasing_id()
    return materialise(each.select(c.alias("c"), F.lit(mine).alias("mine"), "h1", "h2", F.size("codes").alias("n"), "codes", "m", "lo", "hi"), "link-nodes")


def _starts(nodes: DataFrame) -> DataFrame:
    """mine, c, codes, at: a row for each run of three words; a shorter text has one."""
    return nodes.select("mine", "c", "codes", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - RUNS[0], F.lit(0)))).alias("at"))


def _run(k: int) -> Column:
    """The hash of the k words from `at` on, cut at the end of the text."""
    return F.xxhash64(F.lit(k), *[F.get("codes", F.col("at") + j) for j in range(k)])


def _rarity(total: Column, holders: Column) -> Column:
    """Whole millionths, so that sums do not depend on the order of a shuffle."""
    return F.round(1e6 * F.log(1 + total / holders)).cast("bigint")


def _meet(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (h, mine, item) brought together by h. First the groups of both sides: h, rs, ws, each item once; then the
    rows of keys that more than CROWD rows hold, which are not gathered."""
    tagged = tag_heavy(rows, "h", CROWD)
    lists = [F.array_distinct(F.collect_list(F.when(side, F.col("item")))).alias(name) for name, side in (("rs", F.col("mine")), ("ws", ~F.col("mine")))]
    groups = tagged.where("c is null").select("h", "mine", "item").groupBy("h").agg(*lists).where((F.size("rs") > 0) & (F.size("ws") > 0))
    return materialise(groups, "link-groups"), tagged.where("c is not null").select("h", "mine", "item")


def _many() -> Column:
    return F.size("rs").cast("bigint") * F.size("ws") > F.lit(BOUND)


def _all_pairs(groups: DataFrame, total: Column) -> DataFrame:
    """r, w, weight of groups that lead to at most BOUND pairs."""
    few = groups.where(~_many()).select(F.explode("rs").alias("r"), "ws", _rarity(total, F.size("rs")).alias("weight"))
    return few.select("r", F.explode("ws").alias("w"), "weight")


def _alignable(cell: pa.Table) -> pa.Table:
    """r, w of a cell (mine, c, bag: the words' places) whose words can be aligned to COVER_NEAR. In any order they have no
    fewer in common, nor have words that fall together: no pair that can be aligned so far is left out."""
    mine = cell.column("mine").to_numpy()

    def side(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = cell.filter(pa.array(rows))
        bags = pa.concat_arrays(own.column("bag").chunks) if own.num_rows else pa.array([], pa.list_(pa.int16()))
        n = bags.value_lengths().to_numpy()
        at = np.repeat(np.arange(len(n)), n) * BUCKETS + bags.flatten().to_numpy()
        return own.column("c").to_numpy(), n, np.bincount(at, minlength=len(n) * BUCKETS).reshape(len(n), BUCKETS).astype("f4")

    (r, r_n, r_words), (w, w_n, w_words) = side(mine), side(~mine)
    most = np.minimum(r_words @ (w_words > 0).T.astype("f4"), (r_words > 0).astype("f4") @ w_words.T)
    i, j = np.nonzero(most >= COVER_NEAR * np.minimum.outer(r_n, w_n))
    return pa.table({"r": pa.array(r[i], pa.int64()), "w": pa.array(w[j], pa.int64())})


def _heavy_pairs(rows: DataFrame) -> DataFrame:
    """r, w: of rows (h, mine, c, codes) all pairs of a key that can be aligned. A key's nodes are dealt into cells of about
    CELL of either side, so that none is gathered whole."""
    parts = lambda side: F.ceil(F.count_if(side) / CELL)
    sizes = rows.groupBy("h").agg(parts(F.col("mine")).alias("rs"), parts(~F.col("mine")).alias("ws")).where("rs > 0 and ws > 0")
    bag = F.transform("codes", lambda x: F.pmod(x, F.lit(BUCKETS)).cast("smallint")).alias("bag")
    dealt = rows.join(sizes, "h").select("h", "mine", "c", bag, "rs", "ws", F.xxhash64("c").alias("deal"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    mine = dealt.where("mine").select("h", F.pmod("deal", "rs").alias("i"), every("ws").alias("j"), "mine", "c", "bag")
    theirs = dealt.where("not mine").select("h", every("rs").alias("i"), F.pmod("deal", "ws").alias("j"), "mine", "c", "bag")
    return mine.unionByName(theirs).groupBy("h", "i", "j").applyInArrow(_alignable, "r bigint, w bigint").distinct()


def _endings(titles: DataFrame, whole: str, tail: str, first: int) -> DataFrame:
    """chapter, kind, ending: the chapter itself as `whole`, and its ends from the character `first` on as `tail`. One
    row a distinct chapter and end, so that titles that end alike meet, whichever is the shorter."""
    c = titles.where("chapter is not null").select("chapter").distinct()
    at = c.select("chapter", F.explode(F.sequence(F.lit(first), F.greatest(F.length("chapter"), F.lit(first)))).alias("at"))
    tails = at.where(F.col("at") <= F.length("chapter")).select("chapter", F.lit(tail).alias("kind"), F.xxhash64(F.col("chapter").substr(F.col("at"), F.length("chapter"))).alias("ending"))
    return tails.unionByName(c.select("chapter", F.lit(whole).alias("kind"), F.xxhash64("chapter").alias("ending")))


def _shifts(best: DataFrame) -> DataFrame:
    """collection, source, near, shift: how far a neighbourhood of a source's numbers lies from the collection's, as
    most of its rows' best pairs (collection, r_no, source, w_no) have it."""
    n = best.where("r_no is not null and w_no is not null").groupBy("collection", "source", F.floor(F.col("w_no") / NEAR).alias("near"), (F.col("w_no") - F.col("r_no")).alias("shift")).agg(F.count(F.lit(1)).alias("n"))
    wide = n.select("collection", "source", F.explode(F.array(*[F.col("near") + d for d in (-1, 0, 1)])).alias("near"), "shift", "n")
    wide = wide.groupBy("collection", "source", "near", "shift").agg(F.sum("n").alias("n"))
    return wide.groupBy("collection", "source", "near").agg(F.max(F.struct("n", -F.abs("shift"), "shift")).alias("top")).where("top.n >= 2").select("collection", "source", "near", "top.shift")


def _by_place(mine: DataFrame, theirs: DataFrame, shifts: DataFrame, total: Column) -> DataFrame:
    """r, w, weight of rows that share a run with too many others: mine has run, item, id, collection, number, chapter,
    theirs run, item, source, number, chapter.

    Their keys are the run alone and the run with a place. All pairs of a key meet up to BOUND, else each of its rows
    of theirs meets the item of the lowest id.
    """
    near = lambda no: F.floor(no / NEAR)
    around = lambda no: F.explode(F.array(*[near(no) + d for d in (-1, 0, 1)]))
    my_item, bare = F.struct("id", "item"), F.xxhash64(F.lit("run"), "run")
    mine_keys = mine.select("run", my_item.alias("i"), bare.alias("h"))
    ends = mine.join(_endings(mine, "whole", "tail", 1), "chapter").select("run", my_item.alias("i"), F.xxhash64("kind", "run", "ending").alias("h"))
    numbered = mine.where("number is not null")
    mine_keys = mine_keys.unionByName(ends).unionByName(numbered.select("run", my_item.alias("i"), F.xxhash64(F.lit("near"), "run", near(F.col("number"))).alias("h")))
    mine_keys = mine_keys.unionByName(numbered.select("run", my_item.alias("i"), F.xxhash64(F.lit("shift"), "run", "collection", near(F.col("number"))).alias("h")))
    their_keys = theirs.select("run", "item", bare.alias("h"))
    their_keys = their_keys.unionByName(theirs.join(_endings(theirs, "tail", "whole", 2), "chapter").select("run", "item", F.xxhash64("kind", "run", "ending").alias("h")))
    spread = theirs.where("number is not null").select("run", "item", "source", "number", around(F.col("number")).alias("near"))
    their_keys = their_keys.unionByName(spread.select("run", "item", F.xxhash64(F.lit("near"), "run", "near").alias("h")))
    moved = theirs.where("number is not null").withColumn("near", near(F.col("number"))).join(shifts, ["source", "near"])
    moved = moved.select("run", "item", "collection", around(F.col("number") - F.col("shift")).alias("near"))
    their_keys = their_keys.unionByName(moved.select("run", "item", F.xxhash64(F.lit("shift"), "run", "collection", "near").alias("h")))

    mine_keys, their_keys = materialise(mine_keys, "link-places"), materialise(their_keys, "link-places")
    both = mine_keys.select("h", F.lit(True).alias("mine"), F.col("i.item").alias("item")).unionByName(their_keys.select("h", F.lit(False).alias("mine"), "item"))
    groups, _ = _meet(both)
    pairs = _all_pairs(groups, total)
    # Keys of many pairs, gathered or not: the lowest of mine, one row a key, for each of theirs.
    lowest = mine_keys.groupBy("h").agg(F.min("i").alias("i"), F.count(F.lit(1)).alias("holders"))
    rest = their_keys.join(groups.where(~_many()).select("h"), "h", "left_anti").select("h", F.col("item").alias("w")).distinct()
    lows = rest.join(lowest, "h").select(F.col("i.item").alias("r"), "w", _rarity(total, F.col("holders")).alias("weight"))
    return pairs.unionByName(lows)


def common_words(a: list, b: list) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    at: dict = {}
    for i, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        if m := at.get(x):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(b) - v.bit_count()


def _lists(column: pa.ListArray) -> list[list[int]]:
    """A list column without nulls as Python lists, its values converted at once."""
    values, ends = column.flatten().to_numpy().tolist(), column.value_lengths().to_numpy().cumsum().tolist()
    return [values[a:b] for a, b in zip([0, *ends], ends)]


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        common = pa.array([common_words(a, b) for a, b in zip(_lists(batch.column("r_codes")), _lists(batch.column("w_codes")))], pa.int32())
        keep = [i for i, name in enumerate(batch.schema.names) if name not in ("r_codes", "w_codes")]
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], common], names=[*[batch.schema.names[i] for i in keep], "common"])


def candidates(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """r, w, weight: the pruned candidate graph of two tables of nodes."""
    total = mine.agg(F.count(F.lit(1)).alias("n")).scalar()
    nodes = mine.unionByName(theirs)
    starts, edges, heavy = _starts(nodes), None, None
    for k in RUNS:
        runs = starts.withColumn("h", _run(k))
        groups, crowd = _meet(runs.select("h", "mine", F.col("c").alias("item")))
        pairs = _all_pairs(groups, total)
        edges = pairs if edges is None else edges.unionByName(pairs)
        hot = materialise(groups.where(_many()).select("h").unionByName(crowd.select("h").distinct()), "link-hot")
        if k == RUNS[-1] or hot.isEmpty():
            break
        # Hot runs' places are read off the texts again, so that no place rides through the shuffles above.
        starts = materialise(runs.join(hot, "h", "left_semi"), "link-starts")
        if heavy is None:
            heavy = materialise(_heavy_pairs(starts.select("h", "mine", "c", "codes")), "link-heavy")
    # One shuffle by the row: its edges are summed and averaged where they lie.
    edges = edges.repartition("w").groupBy("w", "r").agg(F.sum("weight").alias("weight"))
    mean = F.avg("weight").over(Window.partitionBy("w"))
    edges = edges.withColumn("strong", F.col("weight") >= mean)
    theirs_at = theirs.select(F.col("c").alias("w"), F.col("lo").alias("w_lo"), F.col("hi").alias("w_hi"))
    mine_at = mine.select(F.col("c").alias("r"), F.col("lo").alias("r_lo"), F.col("hi").alias("r_hi"))
    near = (F.col("r_lo") - NEAR <= F.col("w_hi")) & (F.col("w_lo") - NEAR <= F.col("r_hi"))
    kept = edges.join(theirs_at, "w").join(mine_at, "r").where(F.col("strong") | F.coalesce(near, F.lit(False))).select("r", "w", "weight")
    if heavy is None:
        return kept
    return kept.unionByName(heavy.withColumn("weight", F.lit(0).cast("bigint"))).groupBy("r", "w").agg(F.max("weight").alias("weight"))


def _score(pairs: DataFrame) -> DataFrame:
    """pairs with score, from the alignment, the chapter and the neighbours' vote of the last round (null: no say)."""
    vote = F.coalesce("vote", F.lit(0.5))
    chapter = F.when(F.col("same_chapter").isNull(), vote).otherwise(F.col("same_chapter").cast("double"))
    return pairs.withColumn("score", W_TEXT * F.col("cover") + W_NEAR * vote + W_CHAPTER * chapter)


def _vote(pairs: DataFrame) -> DataFrame:
    """Each pair's vote: of the confidence on other rows' leading pairs in the record's neighbourhood, the share
    whose number shift agrees with this pair's. Sums by (collection, source,
    neighbourhood, shift): no pairs of pairs."""
    led = pairs.where("leads and shift is not null").select("collection", "source", "near", "shift", F.round("score", 6).cast("decimal(12,6)").alias("s"))
    by_shift = led.groupBy("collection", "source", "near", "shift").agg(F.sum("s").alias("s"))
    spread = by_shift.select("collection", "source", F.explode(F.array(*[F.col("near") + d for d in (-1, 0, 1)])).alias("near"), "shift", "s")
    spread = spread.groupBy("collection", "source", "near", "shift").agg(F.sum("s").alias("s"))
    total = spread.groupBy("collection", "source", "near").agg(F.sum("s").alias("all_s"))
    alike = spread.select("collection", "source", "near", F.explode(F.array(*[F.col("shift") + d for d in range(-AGREE, AGREE + 1)])).alias("shift"), "s")
    alike = alike.groupBy("collection", "source", "near", "shift").agg(F.sum("s").alias("like_s"))
    out = pairs.withColumnRenamed("vote", "before").join(total, ["collection", "source", "near"], "left").join(alike, ["collection", "source", "near", "shift"], "left")
    # A row has no vote on its own partner: its leading pair is taken out wherever it was counted.
    mine = F.max(F.when(F.col("leads") & F.col("shift").isNotNull(), F.struct("collection", "near", "shift", F.round("score", 6).alias("s")))).over(Window.partitionBy("w"))
    out = out.withColumn("mine", mine)
    here = (F.col("mine.collection") == F.col("collection")) & (F.abs(F.col("mine.near") - F.col("near")) <= 1)
    own_all = F.when(here, F.col("mine.s")).otherwise(0.0)
    own_like = F.when(here & (F.abs(F.col("mine.shift") - F.col("shift")) <= AGREE), F.col("mine.s")).otherwise(0.0)
    rest = F.coalesce(F.col("all_s").cast("double"), F.lit(0.0)) - own_all
    like = F.coalesce(F.col("like_s").cast("double"), F.lit(0.0)) - own_like
    vote = F.when(F.col("shift").isNotNull() & (rest > 0.5), F.greatest(like, F.lit(0.0)) / rest)
    # Half the last vote stays, so that two pairs cannot hand the lead to and fro for ever.
    return out.withColumn("vote", F.coalesce((vote + F.col("before")) / 2, vote)).drop("all_s", "like_s", "before", "mine")


def _lead(pairs: DataFrame) -> DataFrame:
    """pairs with leads (each row's best pair; of equal scores the one of the nearer number, then the heavier edge), left (led before, and leads no more) and moved."""
    best = Window.partitionBy("w").orderBy("left", F.col("score").desc(), F.abs("shift").asc_nulls_last(), F.col("weight").desc(), F.col("r"))
    now = pairs.withColumn("now", F.row_number().over(best) == 1)
    return now.withColumns({"left": F.col("left") | (F.col("leads") & ~F.col("now")), "moved": F.col("now") & ~F.col("leads"), "leads": F.col("now")}).drop("now")


def link(records: DataFrame, rows: DataFrame) -> DataFrame:
    """record_id, witness_id, confidence, cover, vote of the matched pairs.

    records: id, collection, seq, number, chapter, text; rows: id, source, number, chapter, text; ids
    unique and not null, collections and sources not null (each numbers its rows in its own way).
    Null and wordless texts match nothing; null numbers and chapters give no evidence either way; copies of one text
    are told apart by place: by what the neighbours say, then the nearer number, and where rows give none, the lowest
    id wins. Empty tables give no pairs. Columns beside
    those named are never read.
    """
    rec, wit = materialise(_rows_of(records, "collection", "seq"), "link-records"), materialise(_rows_of(rows, "source"), "link-rows")
    mine, theirs = _nodes(rec, True), _nodes(wit, False)
    rec = materialise(rec.drop("codes").join(mine.select("h1", "h2", "c", "m"), ["h1", "h2"]).drop("h1", "h2"), "link-members")
    wit = materialise(wit.drop("codes").join(theirs.select("h1", "h2", "c", "m"), ["h1", "h2"]).drop("h1", "h2"), "link-members")
    edges = candidates(mine, theirs)
    r_node = mine.select(F.col("c").alias("r"), F.col("n").alias("r_n"), F.col("m").alias("r_m"), F.col("codes").alias("r_codes"))
    w_node = theirs.select(F.col("c").alias("w"), F.col("n").alias("w_n"), F.col("m").alias("w_m"), F.col("codes").alias("w_codes"))
    texts = edges.join(r_node, "r").join(w_node, "w")
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.drop("r_codes", "w_codes").schema.fields)
    aligned = texts.mapInArrow(_align, f"{shape}, common int").withColumn("cover", F.col("common") / F.least("r_n", "w_n"))
    nodes = materialise(aligned.where(F.col("cover") >= COVER_NEAR), "link-aligned")

    few = nodes.where(F.col("r_m") * F.col("w_m") <= BOUND)
    r_side = rec.select(F.col("c").alias("rc"), F.col("id").alias("r"), "collection", "seq", F.col("number").alias("r_no"), F.col("chapter").alias("r_chapter"))
    w_side = wit.select(F.col("c").alias("wc"), F.col("id").alias("w"), "source", F.col("number").alias("w_no"), F.col("chapter").alias("w_chapter"))
    at_nodes = nodes.withColumnsRenamed({"r": "rc", "w": "wc"})
    opened = few.withColumnsRenamed({"r": "rc", "w": "wc"}).join(r_side, "rc").join(w_side, "wc")
    many = at_nodes.where(F.col("r_m") * F.col("w_m") > BOUND)
    if not many.isEmpty():
        # Copies beyond BOUND: a node pair's rows meet by place, the record's node standing for the run.
        lone = few.where("r_m = 1 and w_m = 1").groupBy("w").agg(F.max(F.struct("cover", "weight", "r")).alias("best")).select(F.col("w").alias("wc"), F.col("best.r").alias("rc"))
        shifts = _shifts(lone.join(r_side, "rc").join(w_side, "wc"))
        my = rec.join(many.select(F.col("rc").alias("c")).distinct(), "c").select(F.col("c").alias("run"), F.col("id").alias("item"), "id", "collection", "number", "chapter")
        their = wit.join(many.select("rc", F.col("wc").alias("c")), "c").select(F.col("rc").alias("run"), F.col("id").alias("item"), "source", "number", "chapter")
        total = mine.agg(F.count(F.lit(1)).alias("n")).scalar()
        met = materialise(_by_place(my, their, shifts, total).select("r", "w").distinct(), "link-copies")
        opened = opened.unionByName(met.join(r_side, "r").join(w_side, "w").join(many, ["rc", "wc"]))
    ends_alike = F.col("r_chapter").endswith(F.col("w_chapter")) | F.col("w_chapter").endswith(F.col("r_chapter"))
    pairs = opened.select(
        "r", "w", "weight", "collection", "source", "seq", "r_n", "w_n", "cover",
        (F.col("common") / F.col("r_n")).alias("r_cover"),
        ends_alike.alias("same_chapter"),
        (F.col("w_no") - F.col("r_no")).alias("shift"),
        F.floor(F.col("r_no") / NEAR).alias("near"),
        F.lit(None).cast("double").alias("vote"),
        F.lit(False).alias("leads"), F.lit(False).alias("left"),
    )
    state, rounds = materialise(_lead(_score(pairs)), "link-round"), 0
    while not state.where("moved").isEmpty():
        state, rounds = materialise(_lead(_score(_vote(state))), "link-round"), rounds + 1
    log.info("linkage settled after %d rounds", rounds)
    lead = state.where(F.col("leads") & ((F.col("cover") >= COVER) | (F.col("vote") >= 0.5)))
    # A row that runs on into the record's neighbour carries that one too, as far as its own words show it.
    of = lead.select("w", F.col("collection").alias("c0"), F.col("seq").alias("s0"), F.col("r_n").alias("n0"), F.col("r").alias("r0"))
    also = state.where("not leads").join(of, "w").where(
        (F.col("collection") == F.col("c0")) & (F.abs(F.col("seq") - F.col("s0")) <= NEXT) & (F.col("r_cover") >= COVER - 0.05) & (F.col("w_n") >= F.col("n0") + 0.4 * F.col("r_n"))
    )
    cols = [F.col("r").alias("record_id"), F.col("w").alias("witness_id"), F.round(F.least(F.lit(1.0), F.col("score")), 4).alias("confidence"), F.col("cover"), F.col("vote")]
    return lead.select(*cols).unionByName(also.select(*cols))


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match of the narrations of records with rows of witness, with its confidence. Of an id the latest row
    counts."""
    rec = latest_by(table(spark, sf_dir, "records"), ["id"], "loaded_at", ["corpus", "layer", "seq", "number", "kitab", "textraw"])
    rec = rec.where(F.col("layer").isin("matn", "zawaid")).select("id", F.coalesce("corpus", F.lit("")).alias("collection"), "seq", "number", F.col("kitab.titlear").alias("chapter"), F.col("textraw").alias("text"))
    wit = latest_by(table(spark, sf_dir, "witness"), ["witness_id"], "loaded_at", ["edition", "number", "kitab_title", "text"])
    return link(rec, wit.select(F.col("witness_id").alias("id"), F.coalesce("edition", F.lit("")).alias("source"), "number", F.col("kitab_title").alias("chapter"), "text"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matched pairs."""
    return p3_links(spark, sf_dir).select("record_id", "witness_id").distinct()


QUERIES = {"p3_found": p3_found, "p3_links": p3_links}
ORACLE: dict[str, str] = {}
