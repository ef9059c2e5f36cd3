"""Lines into records, records into a hierarchy: sessionising by boundaries, running indexes, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions import text as X
from wordloom.operators.scan import Scan, scan


def lines_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row a line: key, line (0-based), value. Null texts have no line; an empty text has one."""
    cut = F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), "\n")
    return df.select(key, F.posexplode(cut).alias("line", "value"))


def _lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")


def fold_continuations(texts: DataFrame, key: str, text: str, mark, join: str = " ") -> DataFrame:
    """Lines for which mark(line) holds go on from the line before; one row a logical line: key, line (its first), value.

    A text is cut and put together where it lies: nothing is shuffled. A first line that is marked starts a logical
    line all the same; a null text has none.
    """

    def folded(lines: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | ~mark(F.get(lines, i)))
        return X.let(at, lambda starts: F.transform(starts, lambda i, k: F.struct(i.alias("line"), F.array_join(F.slice(lines, i + 1, F.coalesce(F.get(starts, k + 1), F.size(lines)) - i), join).alias("value"))))

    return texts.where(F.col(text).isNotNull()).select(key, F.inline(X.let(_lines(F.col(text)), folded)))


def segment_records(texts: DataFrame, key: str, text: str, opens, heads) -> DataFrame:
    """Lines into records: a line for which opens(line) or heads(line) holds begins one, other lines belong to the last
    begun (lines before any boundary to record 0). key, rec, kind (opener, heading, front), first_line, lines, chars.
    A text is read where it lies, without a shuffle; a null text has no record."""

    def cut(lines: Column) -> Column:
        edge = lambda x: F.coalesce(heads(x) | opens(x), F.lit(False))
        at = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | edge(F.get(lines, i)))
        return X.let(at, lambda starts: F.transform(starts, lambda i, k: record(lines, starts, i, k, edge)))

    def record(lines: Column, starts: Column, i: Column, k: Column, edge) -> Column:
        n = F.coalesce(F.get(starts, k + 1), F.size(lines)) - i
        first, front = F.get(lines, i), ~edge(F.get(lines, 0))
        kind = F.when(F.coalesce(heads(first), F.lit(False)), "heading").when(F.coalesce(opens(first), F.lit(False)), "opener").otherwise("front")
        chars = F.aggregate(F.slice(lines, i + 1, n), F.lit(0).cast("bigint"), lambda a, x: a + F.length(x))
        no = (k + F.when(front, 0).otherwise(1)).cast("bigint")
        return F.struct(no.alias("rec"), kind.alias("kind"), i.alias("first_line"), n.cast("bigint").alias("lines"), chars.alias("chars"))

    return texts.where(F.col(text).isNotNull()).select(key, F.inline(X.let(_lines(F.col(text)), cut)))


def hierarchy(records: DataFrame, collection: str, order: str, top: Column, sub: Column, title: str) -> DataFrame:
    """records with top_no (running count of top headings), sub_no (of sub headings since the last top heading),
    top_title and sub_title as inherited."""
    marked = records.withColumns(
        {
            "__top": F.when(top, 1).otherwise(0),
            "__sub": F.when(sub, 1).otherwise(0),
            "__top_title": F.when(top, F.struct(F.col(title).alias("t"))),
            "__sub_title": F.when(sub, F.struct(F.col(title).alias("t"))).when(top, F.struct(F.lit(None).cast("string").alias("t"))),
        }
    )
    got = scan(marked, [collection], order, [Scan("top_no", "sum", "__top"), Scan("__subs", "sum", "__sub"), Scan("__tt", "last", "__top_title"), Scan("__st", "last", "__sub_title")])
    at_top = got.withColumn("__base", F.when(F.col("__top") == 1, F.col("__subs")))
    got = scan(at_top, [collection], order, [Scan("__from", "last", "__base")])
    out = got.withColumns({"sub_no": F.col("__subs") - F.coalesce("__from", F.lit(0)), "top_title": F.col("__tt.t"), "sub_title": F.col("__st.t")})
    return out.drop("__top", "__sub", "__top_title", "__sub_title", "__subs", "__tt", "__st", "__base", "__from")


def latch(records: DataFrame, collection: str, order: str, when: Column, name: str) -> DataFrame:
    """records with `name`: true from the first row on where `when` holds; it never falls back."""
    got = scan(records.withColumn("__hit", F.when(when, 1).otherwise(0)), [collection], order, [Scan("__n", "sum", "__hit")])
    return got.withColumn(name, F.col("__n") > 0).drop("__hit", "__n")


def display_numbers(records: DataFrame, collection: str, order: str, numbered: Column) -> DataFrame:
    """records with display_no: 1, 2, ... over the numbered rows of a collection, null on others."""
    got = scan(records.withColumn("__hit", F.when(numbered, 1).otherwise(0)), [collection], order, [Scan("__n", "sum", "__hit")])
    return got.withColumn("display_no", F.when(F.col("__hit") == 1, F.col("__n"))).drop("__hit", "__n")


def phantom_index(records: DataFrame, collection: str, order: str, top: Column, sub: Column) -> DataFrame:
    """records with phantom_no: the order's place plus one for every earlier top heading that no sub heading follows."""
    marked = records.withColumns({"__one": F.lit(1), "__top": F.coalesce(top, F.lit(False)), "__sub": F.when(sub, 1).otherwise(0)})
    near = scan(marked, [collection], order, [Scan("__next", "lead", "__sub"), Scan("__place", "sum", "__one")])
    near = near.withColumn("__ghost", F.when(F.col("__top") & (F.coalesce("__next", F.lit(0)) == 0), 1).otherwise(0))
    got = scan(near, [collection], order, [Scan("__ghosts", "sum", "__ghost")])
    return got.withColumn("phantom_no", F.col("__place") + F.col("__ghosts") - F.col("__ghost")).drop("__one", "__top", "__sub", "__next", "__place", "__ghost", "__ghosts")


def neighbours(records: DataFrame, collection: str, order: str, key: str) -> DataFrame:
    """records with before and after: the neighbouring keys, null at a collection's ends."""
    return scan(records, [collection], order, [Scan("before", "lag", key), Scan("after", "lead", key)])


def owners(records: DataFrame, collection: str, order: str, number: str) -> DataFrame:
    """records with owner (the number in force: the last one up to the row) and ahead (the first from the row on)."""
    return scan(records, [collection], order, [Scan("owner", "last", number), Scan("ahead", "next", number)])


def trailing_runs(records: DataFrame, collection: str, order: str, key: str, main: Column, aside: Column) -> DataFrame:
    """The asides that follow each main row without a break: main, key, place (1, 2, ...)."""
    marked = records.withColumns({"__main": F.when(main, F.col(key)), "__main_one": F.when(main, 1).otherwise(0), "__break": F.when(~F.coalesce(main | aside, F.lit(False)), 1).otherwise(0), "__aside": F.when(aside, 1).otherwise(0)})
    got = scan(marked, [collection], order, [Scan("owner", "last", "__main"), Scan("__breaks", "sum", "__break"), Scan("__asides", "sum", "__aside")])
    got = got.withColumn("__at", F.when(F.col("__main_one") == 1, F.struct(F.col("__breaks").alias("b"), F.col("__asides").alias("a"))))
    got = scan(got, [collection], order, [Scan("__since", "last", "__at")])
    run = got.where((F.col("__aside") == 1) & (F.col("__breaks") == F.col("__since.b")))
    return run.select(F.col("owner").alias("main"), key, (F.col("__asides") - F.col("__since.a")).alias("place"))


def missing_numbers(records: DataFrame, collection: str, number: str, span: int = 1000) -> DataFrame:
    """The numbers between a collection's least and greatest that no record has: collection, number.

    The range is made in blocks of `span` numbers, so that a long one is no single row's array.
    """
    have = records.where(F.col(number).isNotNull()).select(collection, F.col(number).cast("bigint").alias("n")).distinct()
    ends = have.groupBy(collection).agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    blocks = ends.select(collection, "lo", "hi", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("hi") - F.col("lo")) / span))).alias("b"))
    first = F.col("lo") + F.col("b") * span
    every = blocks.select(collection, F.explode(F.sequence(first, F.least(first + span - 1, F.col("hi")))).alias("n"))
    return every.join(have, [collection, "n"], "left_anti").select(collection, F.col("n").alias("number"))


def sticky_front(headings: DataFrame, key: str, order: str, depth: str, starts: str, depths: int = 6) -> DataFrame:
    """headings with front: whether a heading lies in front matter. A heading marked by the boolean column `starts`
    opens it at its depth; deeper ones after it stay in it, until one of that depth or less closes it. Depths run from
    1 to `depths`.

    A heading lies in it when for some smaller depth k the last heading of depth k or less before it is a start of
    depth k: what a start inside front matter would hold, the outer one holds too. So a running value a depth is
    enough, and a text of any length is spread over chunks.
    """
    marked, scans = headings, []
    for k in range(1, depths):
        marked = marked.withColumn(f"__at{k}", F.when(F.col(depth) <= k, F.when(F.col(starts) & (F.col(depth) == k), 1).otherwise(0)))
        scans.append(Scan(f"__open{k}", "last", f"__at{k}"))
    got = scan(marked, [key], order, scans)
    inside = F.coalesce(starts, F.lit(False))
    for k in range(1, depths):
        inside = inside | ((F.col(depth) > k) & (F.coalesce(f"__open{k}", F.lit(0)) == 1))
    return got.withColumn("front", inside).drop(*[c for c in got.columns if c.startswith(("__at", "__open"))])


def close_paragraphs(df: DataFrame, key: str, text: str, kinds: dict[str, str]) -> DataFrame:
    """Texts by a grammar of line patterns (top, sub, opener, note; a line is of the first that matches): key, rec,
    layer, first_line, text, note.

    A paragraph without an open record goes by what closed last: after a sub heading or a body it is a body, after a
    top heading a sub heading, before anything front matter. A note closes the record and becomes its note. The rule
    looks back at the last closed kind only. A text is one row and is read where it lies, without a shuffle; null
    texts give nothing.
    """
    import re
    from collections.abc import Iterator

    import pandas as pd

    schema = f"{key} {df.schema[key].dataType.simpleString()}, rec int, layer string, first_line int, text string, note string"
    tests = [(k, re.compile(v)) for k, v in kinds.items()]

    def records(value: str) -> list[dict]:
        recs: list[dict] = []
        open_, closed = None, None
        for line, value in enumerate(re.split(r"\r\n?|\n", value)):
            kind = next((k for k, rx in tests if rx.search(value)), "paragraph")
            if kind == "note" and recs:
                recs[-1]["note"], open_, closed = value, None, "body"
            elif kind in ("top", "sub"):
                recs.append({"layer": kind, "first_line": line, "text": value, "note": None})
                open_, closed = None, kind
            elif kind == "opener" or open_ is None:
                layer = "body" if kind == "opener" or closed in ("sub", "body") else "sub" if closed == "top" else "front"
                recs.append({"layer": layer, "first_line": line, "text": value, "note": None})
                open_, closed = (None if layer == "sub" else recs[-1]), layer
            else:
                open_["text"] += "\n" + value
        return recs

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [{key: k, "rec": n, **r} for k, t in zip(part[key], part[text]) if t is not None for n, r in enumerate(records(t))]
            yield pd.DataFrame(rows, columns=[key, "rec", "layer", "first_line", "text", "note"])

    return df.select(key, text).mapInPandas(run, schema)
