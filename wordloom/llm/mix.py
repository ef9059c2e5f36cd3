"""Problem 7: sources mixed to target shares of the size in tokens, by cube-method balanced sampling.

The total is the largest at which every source that has texts still meets its share within its repeats. A
source's expected repeats per text are then r = share * total / tokens of the source: every text is taken
floor(r) times, and the fraction left is each text's inclusion probability for one time more. The cube method's
flight phase moves these probabilities through the null space of the constraints (tokens and number of texts of
the source, weighted by probability) until all but two of a cell are 0 or 1. Cells are salted parts of a
source, so that a source of any size is spread; what they leave open flies again, in fewer cells, until one
cell a source is left, whose last two texts are the landing problem; exchanges within that cell, where a sample
of the source's settled texts has waited, make up for their rounding. Each source lands by its own size.
"""

from __future__ import annotations

import math
import random
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.llm.encode import Vocab, token_counts
from wordloom.session import materialise, table

#: Texts of a source that one flight takes; open texts of so many cells fly together in the next round.
CELL_ROWS = 20_000
_EPS = 1e-9


def flight(size: list[float], prob: list[float], rng: random.Random) -> list[float]:
    """The cube method's flight under sum(x * size) and sum(x) kept: new probabilities, all but two at most 0 or 1.

    The largest fly first. The order does not touch the inclusion probabilities, but a text much longer than the
    others needs many steps to settle, and the two left for the landing should be short.
    """
    p = list(prob)
    todo = [i for i, x in enumerate(p) if _EPS < x < 1 - _EPS]
    rng.shuffle(todo)
    todo.sort(key=lambda i: size[i])
    hand: list[int] = []
    while True:
        while len(hand) < 3 and todo:
            hand.append(todo.pop())
        if len(hand) == 3:
            a, b, c = (size[i] for i in hand)
            u = (b - c, c - a, a - b)
            if not any(u):
                u = (1.0, -1.0, 0.0)
        elif len(hand) == 2 and size[hand[0]] == size[hand[1]]:
            u = (1.0, -1.0)
        else:
            return p
        up = down = math.inf
        for i, d in zip(hand, u):
            if d > 0:
                up, down = min(up, (1 - p[i]) / d), min(down, p[i] / d)
            elif d < 0:
                up, down = min(up, p[i] / -d), min(down, (1 - p[i]) / -d)
        step = up if rng.random() * (up + down) < down else -down
        for i, d in zip(hand, u):
            p[i] = min(1.0, max(0.0, p[i] + step * d))
        for i in hand:
            p[i] = 0.0 if p[i] <= _EPS else 1.0 if p[i] >= 1 - _EPS else p[i]
        hand = [i for i in hand if 0 < p[i] < 1]


#: Texts of a cell whose sums by twos are tried where single exchanges cannot come nearer; of more, an even choice by
#: size.
PAIRED = 200


def _moves(n: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, list[tuple[int, ...]]]:
    """What the sum of tokens gains by taking texts in or out: one in, one out, one for another, two for one and one for
    two. Of the exchanges of one for another only those that may be the best for some miss are in the first lists."""
    ins, outs = np.flatnonzero(p == 1), np.flatnonzero(p == 0)
    pick = lambda x: x if len(x) <= PAIRED else x[np.argsort(n[x], kind="stable")][np.linspace(0, len(x) - 1, PAIRED).astype(int)]
    gain, what = [-n[ins], n[outs]], [[(int(i),) for i in ins], [(int(j),) for j in outs]]
    few_in, few_out = pick(ins), pick(outs)
    for one, two, sign in ((few_in, few_out, 1), (few_out, few_in, -1)):
        if len(one) and len(two) > 1:
            x, y = np.triu_indices(len(two), 1)
            pairs = n[two[x]] + n[two[y]]
            at = np.argsort(pairs, kind="stable")[np.linspace(0, len(pairs) - 1, min(len(pairs), 4 * PAIRED)).astype(int)]
            gain.append((sign * (pairs[at][None, :] - n[one][:, None])).ravel())
            what.append([(int(i), int(two[x[k]]), int(two[y[k]])) for i in one for k in at])
    return np.concatenate(gain), [m for w in what for m in w]


def landing(size: list[float], prob: list[float]) -> list[float]:
    """The open texts (two at most after a whole flight) set to 0 or 1, the sum of tokens as near to the expected
    one as can be, then the number of texts.

    An open text may be far longer than the rest, and rounding it then misses the sum by much; the miss is made
    up by exchanges within the cell, the best each time, until none comes nearer. Each comes nearer by a whole token
    at least (sizes are whole), so this ends.
    """
    n, p = np.array(size), np.array(prob)
    want, open_ = float(n @ p), np.flatnonzero((p > 0) & (p < 1))
    settled = n @ np.where((p > 0) & (p < 1), 0, p)
    best = min(product((0.0, 1.0), repeat=len(open_)), key=lambda x: (abs(np.dot(x, n[open_]) + settled - want), abs(round(sum(x) - p[open_].sum(), 6)), x))
    p[open_] = best
    while True:
        miss = want - float(n @ p)
        ins, outs = np.flatnonzero(p == 1), np.flatnonzero(p == 0)
        if abs(miss) < 1:
            break
        gap, move = abs(miss), None
        if len(ins) and len(outs):
            by = outs[np.argsort(n[outs], kind="stable")]
            at = np.searchsorted(n[by], n[ins] + miss)
            gap, i, j = min([(abs(miss - (n[by[k]] - n[i])), int(i), int(by[k])) for i, m in zip(ins, at) for k in (m - 1, m) if 0 <= k < len(by)] + [(gap, -1, -1)])
            move = (i, j) if i >= 0 else None
        if gap >= 1:
            gain, what = _moves(n, p)
            k = int(np.argmin(np.abs(miss - gain)))
            if abs(miss - gain[k]) < gap:
                gap, move = abs(miss - gain[k]), what[k]
        if move is None or gap > abs(miss) - 1e-6:
            break
        p[list(move)] = 1 - p[list(move)]
    return p.tolist()


def _fly(cell: pd.DataFrame) -> pd.DataFrame:
    """One cell's flight, and in a source's only cell the landing. The cell's own name seeds it: a task run again after
    an executor is lost chooses alike."""
    cell = cell.sort_values("key", kind="stable")
    rng = random.Random(f"{cell['source'].iloc[0]}|{cell['cell'].iloc[0]}|{len(cell)}")
    p = flight(cell["n"].tolist(), cell["p"].tolist(), rng)
    if cell["cells"].iloc[0] <= 1:
        p = landing(cell["n"].tolist(), p)
    return cell.assign(p=p)


def mix(sizes: DataFrame, targets: DataFrame, total: float | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Columns id, source, n_tokens, copies (1 or more) of the chosen texts.

    sizes has id, source, n_tokens; targets has source, target_share, max_repeats (a source named twice counts
    with its largest share). Rows of sizes without a source, of a source without a target, or without tokens are
    never chosen; a source without texts leaves its share empty. With a total given, a source whose cap is below
    its share gives all it may. Null or negative shares and repeats count as 0. No target, no text: no rows.
    """
    t = targets.where(F.col("source").isNotNull()).groupBy("source").agg(
        F.max(F.greatest(F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)), F.lit(0.0))).alias("share"),
        F.max(F.greatest(F.coalesce(F.col("max_repeats").cast("double"), F.lit(0.0)), F.lit(0.0))).alias("cap"),
    )
    rows = sizes.select("id", "source", "n_tokens").where(F.col("source").isNotNull() & (F.col("n_tokens") > 0))
    have = rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("texts"))
    # One row a listed source; the hash join below follows Spark's own size check.
    plan = materialise(t.join(have, "source").where("share > 0 and cap > 0"), "mix-plan")
    most = plan.agg(F.min(F.col("cap") * F.col("tokens") / F.col("share")).alias("t"), F.max("texts").alias("n")).first()
    if most["t"] is None:
        return rows.limit(0).withColumn("copies", F.lit(1))
    whole = most["t"] if total is None else float(total)
    r = F.least(F.col("cap"), F.col("share") * whole / F.col("tokens"))
    plan = plan.select("source", F.floor(r + _EPS).cast("int").alias("base"), F.greatest(r - F.floor(r + _EPS), F.lit(0.0)).alias("p"), "texts")
    units = rows.join(plan, "source").select(
        F.col("id"), "source", "n_tokens", "base", "p",
        F.monotonically_increasing_id().alias("no"),
        F.xxhash64("id", "n_tokens").alias("key"),
        F.ceil(F.col("texts") / cell_rows).cast("bigint").alias("cells"),
        (F.pmod(F.xxhash64("id", "source"), F.col("texts")) < cell_rows).alias("pool"),
    ).withColumn("cell", F.pmod(F.xxhash64("id"), F.col("cells"))
    )
    units = materialise(units, "mix-units")
    schema = "no bigint, source string, n double, p double, key bigint, cell bigint, cells bigint, pool boolean"
    open_ = units.where((F.col("p") > _EPS) & (F.col("p") < 1 - _EPS)).select("no", "source", F.col("n_tokens").cast("double").alias("n"), "p", "key", "cell", "cells", "pool")
    cells = math.ceil(most["n"] / cell_rows)
    # Two open texts a cell are left: cell_rows / 2 cells of them make a full cell again.
    fewer = F.ceil(F.col("cells") / (cell_rows // 2)).cast("bigint")
    done = waiting = None
    while True:
        flown = materialise(open_.groupBy("source", "cell").applyInPandas(_fly, schema), "mix-flight")
        if cells <= 1:
            done = flown if done is None else done.unionByName(flown)
            break
        # A source in one cell has landed. Of the others' settled texts some cell_rows a source wait for its last
        # cell, where the landing exchanges them.
        settled = F.col("p").isin(0.0, 1.0)
        left = flown.where((F.col("cells") <= 1) | (settled & ~F.col("pool")))
        done = left if done is None else done.unionByName(left)
        pool = flown.where((F.col("cells") > 1) & settled & F.col("pool"))
        waiting = pool if waiting is None else waiting.unionByName(pool)
        waiting = waiting.withColumns({"cell": F.lit(0).cast("bigint"), "cells": fewer})
        open_ = flown.where((F.col("cells") > 1) & ~settled).withColumns({"cell": F.floor(F.col("cell") / (cell_rows // 2)).cast("bigint"), "cells": fewer})
        open_ = open_.unionByName(waiting.where("cells <= 1"))
        waiting = waiting.where("cells > 1")
        cells = math.ceil(cells / (cell_rows // 2))
    # Rows meet by their own number: ids may be null or repeat.
    extra = done.where("p = 1").select("no", F.lit(1).alias("extra"))
    chosen = units.join(extra, "no", "left")
    copies = F.col("base") + F.coalesce("extra", F.when(F.col("p") >= 1 - _EPS, 1).otherwise(0))
    return chosen.select("id", "source", "n_tokens", copies.cast("int").alias("copies")).where("copies > 0")


def shares(chosen: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """A row a target: what the source has, what was taken, its share of the mix and of what its texts allow.

    share_reached is of the tokens taken in all; share_possible is the target over the sum of the targets of
    sources that have texts, which is the best that can be reached when a listed source has none.
    """
    have = sizes.where("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("tokens_there"), F.count(F.lit(1)).alias("texts_there"))
    took = chosen.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens_taken"), F.sum("copies").alias("texts_taken"), F.max("copies").alias("most_copies")
    )
    out = targets.select("source", "target_share", "max_repeats").join(have, "source", "left").join(took, "source", "left").fillna(0)
    sums = out.agg(F.sum("tokens_taken").alias("taken"), F.sum(F.when(F.col("tokens_there") > 0, F.col("target_share"))).alias("possible"))
    # A one-row aggregate on either side of the division, as scalar subqueries.
    return out.withColumns(
        {
            "share_reached": F.col("tokens_taken") / F.nullif(sums.select("taken").scalar(), F.lit(0)),
            "share_possible": F.when(F.col("tokens_there") > 0, F.col("target_share") / sums.select("possible").scalar()).otherwise(0.0),
        }
    )


def trade(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """A row a listed source that has texts: total_at_cap, the total at which it has given all its repeats; sets_total,
    whether that is the total that mix() takes; and what a mix of that total would be: tokens_then, the tokens that
    all sources could give, and short_then, the sum of the shares that sources ran short of. mix(total=...) takes it.

    The running sums are over the list of sources, a row each, not over texts.
    """
    have = sizes.where("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("tokens_there"))
    t = targets.where("target_share > 0 and max_repeats > 0").select("source", "target_share", "max_repeats").join(have, "source")
    most = F.col("max_repeats") * F.col("tokens_there")
    t = t.withColumns({"most": most, "total_at_cap": most / F.col("target_share")})
    order = Window.orderBy("total_at_cap", "source")
    upto, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(1, Window.unboundedFollowing)
    then = F.sum("most").over(upto) + F.coalesce(F.sum("target_share").over(after), F.lit(0.0)) * F.col("total_at_cap")
    short = F.sum("target_share").over(upto) - F.sum("most").over(upto) / F.col("total_at_cap")
    return t.select(
        "source", "target_share", "max_repeats", "tokens_there", F.floor("total_at_cap").cast("bigint").alias("total_at_cap"), (F.row_number().over(order) == 1).alias("sets_total"),
        F.floor(then + 1e-6).cast("bigint").alias("tokens_then"), F.round(F.greatest(short, F.lit(0.0)), 6).alias("short_then"),
    )


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    listed = table(spark, sf_dir, "mix_targets").select("source").distinct()
    docs = docs.join(listed, "source", "left_semi")
    # The source rides in the key, so that counting needs no join back.
    keyed = docs.select(F.struct("doc_id", "source").alias("key"), "text")
    counted = token_counts(keyed, "key", "text", Vocab.byte_bpe_50k())
    return materialise(counted.select(F.col("id.doc_id").alias("id"), F.col("id.source").alias("source"), "n_tokens"), "mix-sizes")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, copies: the texts of the mix."""
    return mix(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets")).withColumnRenamed("id", "doc_id")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached beside the targets."""
    sizes, targets = _sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    return shares(materialise(mix(sizes, targets), "mix-chosen"), sizes, targets)


def p7_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a larger total would cost: which source runs short at which total, and by how much."""
    return trade(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p7_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a target: whether the mix keeps to the source's repeats, takes whole texts of that source only, and comes
    within a hundredth of the tokens that its share allows, or within its shortest text where texts are so few that
    no whole one comes nearer."""
    sizes, targets = _sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    chosen = materialise(mix(sizes, targets), "mix-chosen")
    own = chosen.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("true_source")), "id").where(F.col("source") == F.col("true_source")).groupBy("source").agg(F.count(F.lit(1)).alias("own"))
    all_ = chosen.groupBy("source").agg(F.count(F.lit(1)).alias("all"))
    least = sizes.where("n_tokens > 0").groupBy("source").agg(F.min("n_tokens").alias("least"))
    got = shares(chosen, sizes, targets).join(all_, "source", "left").join(own, "source", "left").join(least, "source", "left")
    whole = chosen.agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("n")).scalar()
    want = F.col("share_possible") * F.coalesce(whole, F.lit(0))
    near = F.abs(F.col("tokens_taken") - want) <= F.greatest(0.01 * want, F.coalesce(F.col("least"), F.lit(0)))
    return got.select("source", (F.col("most_copies") <= F.col("max_repeats")).alias("within_repeats"), F.col("all").eqNullSafe(F.col("own")).alias("own_texts"), near.alias("on_target"))


QUERIES = {"p7_mix": p7_mix, "p7_shares": p7_shares, "p7_trade": p7_trade, "p7_checked": p7_checked}
ORACLE = {"p7_checked": "SELECT source, true AS within_repeats, true AS own_texts, true AS on_target FROM mix_targets"}
