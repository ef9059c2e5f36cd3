"""Problem 5: text that looks the same in different characters, brought to one form.

A transducer reads grapheme clusters (a base with all marks and unseen characters after it) and writes each
one's canonical cluster. Its mapping is compiled once from rules: compatibility widths and presentation forms from
Unicode's own decompositions, spaces and unseen characters by category, look-alike letters from the lists
below; a trie of all characters and of all pairs of base and mark that Unicode composes, so that the longest match
decides. Letters whose likeness depends on their shape in the word (they look like one letter where they join
the next, like another or none where they end the word) are entries of two clusters: the second is any that they
join. The compiler checks the whole mapping: each source has one output, and every output goes through unchanged.

A text is read once, from left to right; nothing is normalised afterwards. A cluster of several marks, which no
finite table holds, is put together from the trie's matches with its marks in Unicode's order.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.session import materialise, table

# Letters that look the same in every place.
SAME = {
    "۰": "٠", "۱": "١", "۲": "٢", "۳": "٣",  # extended Arabic digits; 4 to 6 differ in shape
    "۷": "٧", "۸": "٨", "۹": "٩",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j",  # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "ο": "o",  # Greek
}
# Fixed values: (letter, what it looks like before a letter it joins, what it looks like at the end of a word);
# None where it looks like no other letter. Farsi yeh has dots only where it joins; keheh is a kaf only there;
# ae never joins, and looks like a final heh.
BY_PLACE = [("ی", "ي", "ى"), ("ک", "ك", None), ("ە", None, "ه")]
# Format characters that do show.
SHOWN_FORMATS = "؀؁؂؃؄؅۝܏࣢"
# Characters of other categories that do not show.
UNSEEN_OTHERS = "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ" + "".join(map(chr, range(0xFE00, 0xFE10)))

# Fixed value: a final yeh without dots under a hamza is the seated hamza, whose final form has no dots either.
SEATED = ("ىٔ", "ئ")
#: Letters that a preceding Arabic letter joins: Arabic letters but for the lone hamza.
_LETTER = regex.compile(r"\p{Arabic}")


def _is_space(ch: str) -> bool:
    return unicodedata.category(ch) in ("Zs", "Zl", "Zp") or ch in "\t\n\r\x0b\x0c\x85"


class Transducer:
    """Compiled once a worker (see compiled()); call it on a string."""

    def __init__(self, same: dict[str, str] = SAME, by_place: list[tuple[str, str | None, str | None]] = BY_PLACE) -> None:
        every = [chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000 and not 0xAC00 <= i < 0xD7A4]
        unseen = {c for c in every if unicodedata.category(c) == "Cf"} - {*SHOWN_FORMATS} | {*UNSEEN_OTHERS}
        self.unseen, self.same, self.by_place = unseen, dict(same), {a: (b, c) for a, b, c in by_place}
        if clash := {*same} & {*self.by_place}:
            raise ValueError(f"a character has two mappings: {sorted(clash)}")
        # One entry a character that changes, by whether it joins a letter after it.
        self.single: dict[str, tuple[str, str]] = {}
        self.joining: set[str] = set()
        for c in every:
            parts = unicodedata.normalize("NFKD", c)
            first = parts[:1]
            if first and _LETTER.match(first) and unicodedata.category(first) == "Lo" and first != "ء":
                self.joining.add(c)
            ends = tuple(self._rule(parts, joins) for joins in (False, True))
            if ends != (c, c) or parts != c and unicodedata.normalize("NFC", parts) != c:
                self.single[c] = ends
        for c in unseen:
            self.single[c] = ("", "")
        # Pairs that Unicode composes: the trie's second edges.
        self.pairs: dict[tuple[str, str], str] = {(SEATED[0][0], SEATED[0][1]): SEATED[1]}
        for c in every:
            d = unicodedata.decomposition(c)
            if d and not d.startswith("<") and " " in d:
                x, y = (chr(int(h, 16)) for h in d.split())
                if unicodedata.normalize("NFC", x + y) == c:
                    self.pairs[x, y] = c
        self._check()
        body = "".join(map(regex.escape, sorted(unseen)))
        self.clusters = regex.compile(rf"[^\p{{M}}{body}]?[\p{{M}}{body}]*+", regex.DOTALL)
        # One character class: those of the basic plane that change, and all beyond it.
        self.touched = re.compile("[" + "".join(re.escape(c) for c in sorted({*self.single, *self.by_place}) if c < "\U00010000") + "\U00010000-\U0010ffff]").search
        self.known: dict[tuple[str, bool], str] = {}

    def _rule(self, parts: str, joins: bool) -> str:
        """What a character's full decomposition becomes by the rules, composed again."""
        out = []
        for i, ch in enumerate(parts):
            if ch in self.by_place:
                # Inside a ligature the next letter is part of the same character.
                inside = any(not unicodedata.combining(x) for x in parts[i + 1 :])
                ch = self.by_place[ch][0 if joins or inside else 1] or ch
            out.append("" if ch in self.unseen else " " if _is_space(ch) else self.same.get(ch, ch))
        return unicodedata.normalize("NFC", "".join(out))

    def _check(self) -> None:
        """Refuses a mapping in which an output would change again, where it stands or in another place."""
        for c, outs in self.single.items():
            for joins, out in enumerate(outs):
                if out == c:
                    continue
                again = "".join(self.single.get(x, (x, x))[joins] for x in out)
                if again != out:
                    raise ValueError(f"the output {out!r} of {c!r} would be mapped again to {again!r}")
        for source, outs in [*((a, (b,)) for a, b in self.same.items()), *self.by_place.items()]:
            for out in filter(None, outs):
                if unicodedata.normalize("NFKC", out) != out:
                    raise ValueError(f"the output {out!r} of {source!r} is not in composed form")
                if out in self.same or out in self.by_place:
                    raise ValueError(f"the output {out!r} of {source!r} is itself mapped")
        for (x, y), out in self.pairs.items():
            if self.single.get(out, (out, out)) != (out, out) and (x, y) != (SEATED[0][0], SEATED[0][1]):
                # A composed letter whose base looks like another takes that one's place.
                self.pairs[x, y] = self.single[out][0]

    def _cluster(self, cluster: str, joins: bool) -> str:
        """The longest matches of the trie in one cluster: its characters' entries, then the pairs among them."""
        mapped = "".join(self.single.get(c, (c, c))[joins] for c in cluster)
        base, marks = mapped[:1], []
        rest: list[str] = []
        for part in mapped[1:]:
            (marks if unicodedata.combining(part) else rest).append(part)
        if rest or len(mapped) < 2:
            return unicodedata.normalize("NFC", mapped).replace(*SEATED)
        # Marks in Unicode's order; one composes with the base unless one of its own class stands between.
        whole = unicodedata.normalize("NFD", base) if base else ""
        base, marks = whole[:1], [*whole[1:], *marks]
        marks.sort(key=unicodedata.combining)
        left: list[str] = []
        for m in marks:
            got = self.pairs.get((base, m)) if not left or unicodedata.combining(left[-1]) != unicodedata.combining(m) else None
            if got:
                base = got
            else:
                left.append(m)
        return base + "".join(left)

    def __call__(self, text: str | None) -> str | None:
        """Null stays null; spaces at the ends do not show and go, and a run of spaces is one."""
        if text is None:
            return None
        if not self.touched(text) and unicodedata.is_normalized("NFC", text) and SEATED[0] not in text:
            # No entry matches anywhere; only spaces may have to go.
            return " ".join(x for x in text.split(" ") if x) if " " in text else text
        cut = [c for c in self.clusters.findall(text) if c]
        out, known = [], self.known
        for cluster, after in zip(cut, [*cut[1:], ""]):
            joins = after[:1] in self.joining
            got = known.get((cluster, joins))
            if got is None:
                if len(known) > 200_000:
                    known.clear()
                got = known[cluster, joins] = self._cluster(cluster, joins)
            out.append(got)
        return " ".join(x for x in "".join(out).split(" ") if x)


@lru_cache(maxsize=1)
def compiled() -> Transducer:
    return Transducer()


def canonical(df: DataFrame, columns: list[str], suffix: str = "_canon") -> DataFrame:
    """df with each of `columns` in its canonical form as column + suffix (an equal name is replaced). Null
    stays null; the empty string and one of unseen characters only become empty."""

    @F.pandas_udf("string")
    def canon(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        transduce = compiled()
        for part in parts:
            yield pd.Series([transduce(x) if isinstance(x, str) else None for x in part.tolist()], dtype=object)

    return df.withColumns({c + suffix: canon(F.col(c).cast("string")) for c in columns})


def _looks(df: DataFrame, item: str, columns: list[str]) -> DataFrame:
    """item, looks, stored: each distinct row's canonical and stored spellings, as one text each. Rows with a null in
    item or a column are left out."""
    rows = df.select(F.col(item).alias("item"), *[F.col(c).cast("string").alias(f"f{k}") for k, c in enumerate(columns)]).dropna().distinct()
    fields = [f"f{k}" for k in range(len(columns))]
    looks = F.to_json(F.array(*[f"{f}_canon" for f in fields]))
    return materialise(canonical(rows, fields).select("item", looks.alias("looks"), F.to_json(F.array(*fields)).alias("stored")), "looks")


def same_looking_classes(df: DataFrame, item: str, columns: list[str]) -> DataFrame:
    """item, class_id (a hash of the looks), spelling_id (of what is stored), links: with how many items of its class the
    item is stored differently. One row an item and spelling, whatever the size of a class; pairs between spellings
    follow from class_id. Items without a link have 0."""
    rows = _looks(df, item, columns)
    of_item = rows.groupBy("looks", "item").agg(F.count(F.lit(1)).alias("k"))
    of_class = of_item.groupBy("looks").agg(F.count(F.lit(1)).alias("n"))
    # Of a class all are linked but the items that have the same spelling and no other, and the item itself.
    rows = rows.join(of_item, ["looks", "item"])
    alike = rows.groupBy("looks", "stored").agg(F.count_if(F.col("k") == 1).alias("m"))
    got = rows.join(alike, ["looks", "stored"]).join(of_class, "looks")
    links = F.col("n") - F.col("m") - F.when(F.col("k") > 1, 1).otherwise(0)
    return got.select("item", F.xxhash64("looks").alias("class_id"), F.xxhash64("stored").alias("spelling_id"), links.alias("links"))


def same_looking_pairs(df: DataFrame, item: str, columns: list[str]) -> DataFrame:
    """Pairs (a, b), a < b, of different items whose columns all look the same while one is stored differently.

    Rows with a null in item or a column are left out. Within a class of equal looks, pairs are made between
    its distinct stored spellings and only then of their items, so items that share a spelling never meet.
    """
    rows = _looks(df, item, columns)
    forms = rows.select("looks", "stored").distinct()
    a, b = forms.withColumnRenamed("stored", "sa"), forms.withColumnRenamed("stored", "sb")
    pairs = a.join(b, "looks").where(F.col("sa") < F.col("sb")).select("sa", "sb")
    out = pairs.join(rows.select(F.col("stored").alias("sa"), F.col("item").alias("x")), "sa")
    out = out.join(rows.select(F.col("stored").alias("sb"), F.col("item").alias("y")), "sb").where(F.col("x") != F.col("y"))
    return out.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of surface that look alike in all three spellings and are stored differently."""
    pairs = same_looking_pairs(table(spark, sf_dir, "surface"), "match_id", ["vocalized", "unvocalized", "search_key"])
    return pairs.select(F.col("a").alias("match_id_a"), F.col("b").alias("match_id_b"))


def p5_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling of surface in its one form."""
    rows = table(spark, sf_dir, "surface").select("match_id", "vocalized", "unvocalized", "search_key").distinct()
    return canonical(rows, ["vocalized", "unvocalized", "search_key"]).select("match_id", "vocalized_canon", "unvocalized_canon", "search_key_canon").distinct()


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry of surface with its class of equal looks and the number of its links."""
    return same_looking_classes(table(spark, sf_dir, "surface"), "match_id", ["vocalized", "unvocalized", "search_key"]).withColumnRenamed("item", "match_id")


def p5_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row an entry of surface: whether its spellings' forms go through once more unchanged, hold no character that does
    not show, and keep every letter (a form is empty only where its spelling shows nothing)."""
    cols = ["vocalized", "unvocalized", "search_key"]
    once = canonical(table(spark, sf_dir, "surface").select("match_id", *cols).distinct(), cols, "_1")
    twice = canonical(once, [f"{c}_1" for c in cols], "_2")
    ok = lambda c: F.col(f"{c}_1").eqNullSafe(F.col(f"{c}_1_2"))
    clean = lambda c: ~F.coalesce(F.col(f"{c}_1"), F.lit("")).rlike("[\u200b-\u200f\u2060-\u2064\ufeff\u00ad\u061c\ufb50-\ufdfb\ufe70-\ufefc]")
    kept = lambda c: (F.coalesce(F.col(f"{c}_1"), F.lit("")) != "") | ~F.coalesce(F.col(c), F.lit("")).rlike(r"[\p{L}\p{N}]")
    every = lambda f: f(cols[0]) & f(cols[1]) & f(cols[2])
    return twice.select("match_id", every(ok).alias("stable"), every(clean).alias("clean"), every(kept).alias("kept"))


QUERIES = {"p5_found": p5_found, "p5_forms": p5_forms, "p5_classes": p5_classes, "p5_stable": p5_stable}
ORACLE = {"p5_stable": "SELECT match_id, true AS stable, true AS clean, true AS kept FROM (SELECT DISTINCT match_id, vocalized, unvocalized, search_key FROM surface)"}
