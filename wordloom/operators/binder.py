"""Binding tokens to readings by a ladder of evidence, in phases that do not depend on the order of records.

Tiers: 0 marked in the source, 1 the key has one reading, 2 read off an aligned witness, 3 the same neighbours
elsewhere or a governing particle, 4 the most frequent reading, 5 no reading. A tier whose resource is missing is
unavailable, which is not the same as never used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions import text as X
from wordloom.profiles import ARABIC, Profile
from wordloom.session import materialise

# Fixed values: (tier, binding, confidence, what it needs, whether a witness stands behind it).
TIERS = [
    (0, "source", "high", ("marks",), True),
    (1, "unique", "high", ("inventory",), True),
    (2, "aligned", "high", ("inventory", "witness"), True),
    (3, "heuristic", "medium", ("inventory",), False),
    (4, "heuristic", "low", ("inventory",), False),
    (5, "unbound", "none", (), False),
]
SUPPORT, PURITY = 4, (9, 10)
#: Votes that it takes to overrule an alignment.
REPAIR_SUPPORT = 20
#: Words of an aligned block up to which it does not pin down its place, and from which it is trusted.
SHORT_BLOCK, LONG_BLOCK = 2, 3


@dataclass(frozen=True)
class Resources:
    marks: bool = True
    inventory: bool = True
    witness: bool = False

    def available(self) -> list[int]:
        have = {k for k, v in vars(self).items() if v}
        return [n for n, _, _, needs, _ in TIERS if set(needs) <= have]

    def unavailable(self) -> list[int]:
        return [n for n, *_ in TIERS if n not in self.available()]


def inventory(entries: DataFrame) -> DataFrame:
    """key, match_id, form, freq, guess, minted, ord (1 is the most frequent; ties to the lower match_id), n (readings
    of the key). entries: search_key, match_id, vocalized, freq, one row a match_id, and voc_source where the entry's
    own evidence ("aligned:3,lexicon:7") is known: a fallback that outweighs what was aligned is a guess.

    A key's readings are its distinct ids: what a language has for one spelling, a bounded set; a key that holds a
    share of all rows holds it in repeated rows, which fall together before the window.
    """
    guess = F.lit(False)
    if "voc_source" in entries.columns:
        counts = X.parse_counts("voc_source")
        guess = F.coalesce(X.count_under(counts, "lexicon") > X.count_under(counts, "aligned"), F.lit(False))
    rows = entries.withColumn("__guess", guess).where("search_key is not null and match_id is not null and vocalized is not null")
    rows = rows.groupBy(F.col("search_key").alias("key"), "match_id").agg(F.min("vocalized").alias("form"), F.max(F.coalesce("freq", F.lit(0))).alias("freq"), F.max("__guess").alias("guess"))
    return _ordered(rows.withColumn("minted", F.lit(False)))


def _ordered(rows: DataFrame) -> DataFrame:
    """The readings of each key in the order in which they are tried: minted ones last."""
    key = Window.partitionBy("key")
    return rows.withColumns({"ord": F.row_number().over(key.orderBy("minted", F.col("freq").desc(), "match_id")), "n": F.count(F.lit(1)).over(key)})


def extended(inv: DataFrame, forms: DataFrame) -> DataFrame:
    """inv with a minted reading, of freq 0, for each (key, form) of forms that it lacks."""
    new = forms.select("key", "form").where("key is not null and form is not null").distinct().join(inv.select("key", "form").distinct(), ["key", "form"], "left_anti")
    new = new.select("key", X.stable_id("key", "form").alias("match_id"), "form", F.lit(0).cast("bigint").alias("freq"), F.lit(False).alias("guess"), F.lit(True).alias("minted"))
    return _ordered(inv.select("key", "match_id", "form", F.col("freq").cast("bigint").alias("freq"), "guess", "minted").unionByName(new))


def keyed(inv: DataFrame, p: Profile = ARABIC) -> DataFrame:
    """One row a key: n, curated_n (readings, those not minted), top, top_guess (the first reading), gen, acc (the only reading in the case, null where there
    are none or several). Readings are structs (id, form)."""
    reading, ending = F.struct(F.col("match_id").alias("id"), "form"), X.last_vowel("form", p)
    in_case = lambda ends: ending.isin(*ends)
    only = lambda ends: F.when(F.count_if(in_case(ends)) == 1, F.min(F.when(in_case(ends), reading)))
    return inv.groupBy("key").agg(
        F.max("n").alias("n"), F.count_if(~F.col("minted")).alias("curated_n"), F.min_by(reading, "ord").alias("top"), F.min_by("guess", "ord").alias("top_guess"), only(p.genitive_ends).alias("gen"), only(p.accusative_ends).alias("acc")
    )


def bigrams(tokens: DataFrame) -> DataFrame:
    """tokens (record_id, i, key, prev_key, next_key, match_id, tier) as one row a neighbour pair: side, a, b."""
    both = F.array(F.struct(F.lit("L").alias("side"), F.col("prev_key").alias("a"), F.col("key").alias("b")), F.struct(F.lit("R").alias("side"), F.col("key").alias("a"), F.col("next_key").alias("b")))
    return tokens.select("*", F.explode(both).alias("g")).select(*tokens.columns, "g.*").where("a is not null and b is not null")


def votes(tokens: DataFrame) -> DataFrame:
    """side, a, b, match_id, n: what the tokens of tiers 1 and 2 say about each neighbour pair. Tokens marked
    `undetermined` (where there is such a column) do not vote: an alignment must not vouch for itself."""
    sure = tokens.where("tier in (1, 2) and match_id is not null")
    if "undetermined" in tokens.columns:
        sure = sure.where("not undetermined")
    return bigrams(sure).groupBy("side", "a", "b", "match_id").agg(F.count(F.lit(1)).alias("n"))


def verdicts(v: DataFrame, support: int = SUPPORT, purity: tuple[int, int] = PURITY) -> DataFrame:
    """side, a, b, winner, top, total: the pairs whose votes are many and agree. Ties go to the lower id."""
    best = v.groupBy("side", "a", "b").agg(F.min_by("match_id", F.struct(-F.col("n"), F.col("match_id"))).alias("winner"), F.max("n").alias("top"), F.sum("n").alias("total"))
    return best.where((F.col("total") >= support) & (F.col("top") * purity[1] >= F.col("total") * purity[0]))


NEIGHBOURS = ["prev_raw", "prev_key", "prev2_key", "next_key"]


def tokens_of(records: DataFrame, record: str, text: str, *more: str, p: Profile = ARABIC) -> DataFrame:
    """record_id, `more`, i, raw, key and NEIGHBOURS of every word: read off the record's own array before it is
    exploded, so that no window and no shuffle is needed."""
    words = F.transform(X.tokens_of(text, p), lambda t: F.struct(t["raw"].alias("raw"), X.fold_key(t["raw"], p).alias("key")))

    def row(ws: Column) -> Column:
        return F.transform(ws, lambda w, i: F.struct(
            i.alias("i"), w["raw"].alias("raw"), w["key"].alias("key"), F.get(ws, i - 1)["raw"].alias("prev_raw"), F.get(ws, i - 1)["key"].alias("prev_key"),
            F.get(ws, i - 2)["key"].alias("prev2_key"), F.get(ws, i + 1)["key"].alias("next_key"),
        ))

    return records.select(F.col(record).alias("record_id"), *more, F.inline(X.let(words, row)))


def with_neighbours(tokens: DataFrame) -> DataFrame:
    """tokens (record_id, i, raw, key) with NEIGHBOURS, for tables that come without their texts."""
    w = Window.partitionBy("record_id").orderBy("i")
    raw = F.col("raw") if "raw" in tokens.columns else F.lit(None).cast("string")
    return tokens.withColumns({"prev_raw": F.lag(raw).over(w), "prev_key": F.lag("key").over(w), "prev2_key": F.lag("key", 2).over(w), "next_key": F.lead("key").over(w)})


def first_tiers(tokens: DataFrame, keys: DataFrame, forms: DataFrame, curated: bool = True, strict: bool = False) -> DataFrame:
    """tokens (with seen, size and ambiguous where a witness was aligned) with n, top, gen, acc, tier, reading and
    undetermined: tiers 0, 1, 2 and 5; null is open. forms: key, want, want_id, one row a reading's form.

    A block of up to SHORT_BLOCK words does not pin down its place where the witness's row has other forms of the
    key, or where no curated inventory stands against it. strict: a key with one curated reading has one, whatever
    readings were minted beside it.
    """
    if strict:
        keys = keys.withColumn("n", F.when(F.col("curated_n") == 1, F.col("curated_n")).otherwise(F.col("n")))
    got = tokens.join(keys, "key", "left").withColumn("want", F.when(F.col("marks") != "none", F.col("raw")).otherwise(F.col("seen")))
    got = got.join(forms, ["key", "want"], "left")
    n, marked = F.coalesce("n", F.lit(0)), F.col("marks") != "none"
    aligned = (n > 1) & F.col("want_id").isNotNull()
    tier = F.when(marked, 0).when(n == 0, 5).when(n == 1, 1).when(aligned, 2)
    wanted = F.struct(F.coalesce("want_id", X.stable_id("key", "want")).alias("id"), F.col("want").alias("form"))
    reading = F.when(marked, wanted).when(n == 1, F.col("top")).when(aligned, wanted)
    short = (F.col("size") <= SHORT_BLOCK) & (F.col("ambiguous") | F.lit(not curated))
    return got.withColumns({"tier": tier, "reading": reading, "undetermined": F.coalesce((tier == 2) & short, F.lit(False))}).drop("want", "want_id")


def override(tokens: DataFrame, p: Profile = ARABIC, follows: Column | None = None) -> DataFrame:
    """tokens whose word takes the case of the word before it (`follows`; the profile's `son`), two places after a particle of the genitive:
    where just one reading is a genitive it is tier 3, whatever stood there. The text's own syntax beats a witness."""
    follows = F.col("key").isin(*p.son) if follows is None else follows
    hit = follows & F.col("prev2_key").isin(*p.genitive) & F.col("gen").isNotNull() & ~F.col("reading.id").eqNullSafe(F.col("gen.id"))
    hit = F.coalesce(hit, F.lit(False))
    return tokens.withColumns({"tier": F.when(hit, 3).otherwise(F.col("tier")), "reading": F.when(hit, F.col("gen")).otherwise(F.col("reading"))})


def judged(tokens: DataFrame, said: DataFrame) -> DataFrame:
    """tokens with left and right: what the neighbour pairs say of them, as structs (id, form, total)."""
    names = {"L": ("left", "prev_key", "key"), "R": ("right", "key", "next_key")}
    for side, (name, a, b) in names.items():
        one = said.where(F.col("side") == side).select(F.col("a").alias(a), F.col("b").alias(b), F.struct(F.col("winner").alias("id"), "form", "total").alias(name))
        tokens = tokens.join(one, [a, b], "left")
    return tokens


def repaired(tokens: DataFrame, support: int = REPAIR_SUPPORT) -> DataFrame:
    """judged tokens: undetermined ones of tier 2 that votes of `support` and more contradict become tier 3 with the
    votes' reading, the left pair before the right one."""
    says = lambda side: F.col("undetermined") & (F.col("tier") == 2) & (F.col(f"{side}.total") >= support) & (F.col(f"{side}.id") != F.col("reading.id"))
    other = F.when(says("left"), F.struct("left.id", "left.form")).when(says("right"), F.struct("right.id", "right.form"))
    return tokens.withColumns({"tier": F.when(other.isNotNull(), 3).otherwise(F.col("tier")), "reading": F.coalesce(other, "reading")})


def plausible(inv: DataFrame, review: DataFrame) -> DataFrame:
    """key, raw, allowed (a reading): the first reading that the review list (raw, form) allows for a word as written.
    Words the list does not know, or of whose readings it allows none, have no row."""
    listed = review.select("raw", "form", X.fold_key("raw").alias("key")).distinct()
    return listed.join(inv.select("key", "form", "match_id", "ord"), ["key", "form"]).groupBy("key", "raw").agg(F.min_by(F.struct(F.col("match_id").alias("id"), "form"), "ord").alias("allowed"))


def last_tiers(tokens: DataFrame, allowed: DataFrame | None = None, p: Profile = ARABIC) -> DataFrame:
    """judged tokens: what is open becomes tier 3 by the neighbours' votes (left before right) or by the case that the
    particle before it governs, else tier 4 with the most frequent reading, or the first that is plausible."""
    if allowed is not None:
        tokens = tokens.join(allowed, ["key", "raw"], "left")
    best = F.coalesce("allowed", "top") if allowed is not None else F.col("top")
    governed = F.when(F.col("prev_key").isin(*p.genitive), F.col("gen")).when(F.col("prev_key").isin(*p.accusative), F.col("acc"))
    third = F.coalesce(F.when(F.col("left").isNotNull(), F.struct("left.id", "left.form")), F.when(F.col("right").isNotNull(), F.struct("right.id", "right.form")), governed)
    open_ = F.col("tier").isNull()
    got = tokens.withColumns({"reading": F.when(open_, F.coalesce(third, best)).otherwise(F.col("reading")), "tier": F.when(open_, F.when(third.isNotNull(), 3).otherwise(4)).otherwise(F.col("tier"))})
    return got.drop("allowed") if allowed is not None else got


def corrected(tokens: DataFrame, inv: DataFrame, by_token: DataFrame | None = None, by_form: DataFrame | None = None) -> DataFrame:
    """tokens with hand corrections, which win over all else and are tier 1; `fixed` tells them.

    by_token: record_id, i, form; by_form: key, form, place and `after`, the word that must stand before (null: any);
    of several that fit the lowest place counts, and one by token goes before those. A form the inventory lacks is
    minted.
    """
    known = inv.groupBy("key", "form").agg(F.min("match_id").alias("known"))

    def resolved(d: DataFrame) -> DataFrame:
        return d.join(known, ["key", "form"], "left").withColumn("fix", F.struct(F.coalesce("known", X.stable_id("key", "form")).alias("id"), "form")).drop("known", "form")

    fixes: list[Column] = []
    if by_token is not None:
        own = by_token.groupBy("record_id", "i").agg(F.min("form").alias("form")).join(tokens.select("record_id", "i", "key"), ["record_id", "i"])
        tokens = tokens.join(resolved(own).select("record_id", "i", F.col("fix").alias("fix_token")), ["record_id", "i"], "left")
        fixes.append(F.col("fix_token"))
    if by_form is not None:
        rules = resolved(by_form.select("key", "form", "after", "place"))
        first = F.min(F.struct("place", "fix"))
        anywhere = rules.where("after is null").groupBy("key").agg(first.alias("any_fix"))
        behind = rules.where("after is not null").groupBy("key", F.col("after").alias("prev_raw")).agg(first.alias("after_fix"))
        tokens = tokens.join(anywhere, "key", "left").join(behind, ["key", "prev_raw"], "left")
        fixes.append(F.least("any_fix", "after_fix")["fix"])
    if not fixes:
        return tokens.withColumn("fixed", F.lit(False))
    fix = F.coalesce(*fixes)
    got = tokens.withColumn("fix", fix).withColumns({"reading": F.coalesce("fix", "reading"), "tier": F.when(F.col("fix").isNotNull(), 1).otherwise(F.col("tier")), "fixed": F.col("fix").isNotNull()})
    return got.drop("fix", "fix_token", "any_fix", "after_fix")


def rescued(tokens: DataFrame) -> DataFrame:
    """Tokens of tiers 4 and 5 that carry marks of their own are shown as the source has them: tier 0, the reading
    stays. The ladder settles marked tokens first, so this finds work only where a tier was taken from them."""
    return tokens.withColumn("tier", F.when(F.col("tier").isin(4, 5) & (F.col("marks") == "partial"), 0).otherwise(F.col("tier")))


def late_minted(tokens: DataFrame, analysed: DataFrame) -> DataFrame:
    """Unbound tokens whose word as written has an analysis (column form) get an id and can be opened; tier 5 stays."""
    known = analysed.select(F.col("form").alias("raw")).where("raw is not null").distinct().withColumn("__known", F.lit(True))
    got = tokens.join(known, "raw", "left")
    new = (F.col("tier") == 5) & F.col("reading").isNull() & F.col("__known")
    return got.withColumn("reading", F.when(new, F.struct(X.stable_id("key", "raw").alias("id"), F.col("raw").alias("form"))).otherwise(F.col("reading"))).drop("__known")


def shown(tokens: DataFrame, curated: bool = True, p: Profile = ARABIC) -> DataFrame:
    """record_id, i, key, match_id, tier, binding, confidence, clickable, surface, undetermined.

    Medium instead of high: a marked word without its ending; a single reading that is a guess, or the only one ever
    witnessed. The surface has the source's letters with the reading's marks; a trusted block (LONG_BLOCK) that vowels
    a single reading otherwise shows its own vowelling, id and tier stay.
    """
    names = F.create_map(*[x for t, b, _, _, _ in TIERS for x in (F.lit(t), F.lit(b))])
    trust = F.create_map(*[x for t, _, c, _, _ in TIERS for x in (F.lit(t), F.lit(c))])
    doubt = ((F.col("tier") == 0) & (F.col("marks") == "partial")) | ((F.col("tier") == 1) & ((~F.col("fixed") & F.coalesce("top_guess", F.lit(False))) | F.lit(not curated)))
    witness = F.when((F.col("tier") == 1) & ~F.col("fixed") & (F.col("size") >= LONG_BLOCK), F.col("seen"))
    worn = F.when(F.col("tier") == 0, F.col("raw")).otherwise(X.transfer_marks("raw", F.coalesce(witness, "reading.form", "raw"), p))
    return tokens.select(
        "record_id", "i", "key", F.col("reading.id").alias("match_id"), "tier", names[F.col("tier")].alias("binding"),
        F.when(doubt, "medium").otherwise(trust[F.col("tier")]).alias("confidence"), F.col("reading.id").isNotNull().alias("clickable"), worn.alias("surface"), "undetermined",
    )


def bind(
    tokens: DataFrame, inv: DataFrame, witnessed: DataFrame | None = None, review: DataFrame | None = None, by_token: DataFrame | None = None,
    by_form: DataFrame | None = None, analysed: DataFrame | None = None, curated: bool = True, strict: bool = False, p: Profile = ARABIC,
) -> DataFrame:
    """The whole ladder: see shown() for the columns. Every token gets exactly one tier.

    tokens: record_id, i, raw, and key and NEIGHBOURS where tokens_of() made them. witnessed: record_id, i, seen, size,
    ambiguous (an aligned witness's word, its block, whether its row has other forms of the key); without it tier 2 is
    unavailable. The rest: see plausible(), corrected() and late_minted(). All is aligned first, then all is minted
    (marked words; witness's words in trusted blocks, or everywhere where the inventory is not curated), then all is
    bound, so no order of records matters. With `strict` a word of one curated reading keeps it (tier 1) where a trusted
    block vowels it otherwise, and shows the witness's vowelling; without, the minted reading is one more to choose
    from. The hot join is tokens with one row a key; Spark splits its hot partitions.
    """
    toks = tokens if "key" in tokens.columns else tokens.withColumn("key", X.fold_key("raw", p))
    if "prev2_key" not in toks.columns:
        toks = with_neighbours(toks)
    toks = toks.select("record_id", "i", "raw", "key", *NEIGHBOURS, X.mark_class("raw", p).alias("marks"))
    if witnessed is not None:
        toks = materialise(toks.join(witnessed.select("record_id", "i", "seen", "size", "ambiguous"), ["record_id", "i"], "left"), "bind-tokens")
    else:
        toks = toks.withColumns({"seen": F.lit(None).cast("string"), "size": F.lit(None).cast("int"), "ambiguous": F.lit(None).cast("boolean")})
    trusted = F.col("seen").isNotNull() & ((F.col("size") >= LONG_BLOCK) | F.lit(not curated))
    attested = toks.where("marks <> 'none'").select("key", F.col("raw").alias("form")).unionByName(toks.where(trusted).select("key", F.col("seen").alias("form")))
    full = materialise(extended(inv, attested), "bind-inventory")
    forms = full.groupBy("key", F.col("form").alias("want")).agg(F.min("match_id").alias("want_id"))
    # The barrier: what is sure is settled for all records before it votes on the rest.
    sure = materialise(override(first_tiers(toks, keyed(full, p), forms, curated, strict), p), "bind-sure")
    say = sure.select("record_id", "i", "key", "prev_key", "next_key", F.col("reading.id").alias("match_id"), "tier", "undetermined")
    named = full.groupBy("key", F.col("match_id").alias("winner")).agg(F.min("form").alias("form"))
    said = verdicts(votes(say)).withColumn("key", F.when(F.col("side") == "L", F.col("b")).otherwise(F.col("a"))).join(named, ["key", "winner"]).drop("key")
    out = repaired(judged(sure, said))
    out = last_tiers(out, plausible(full, review) if review is not None else None, p)
    out = rescued(corrected(out, full, by_token, by_form))
    return shown(late_minted(out, analysed) if analysed is not None else out, curated, p)


def holdout(tokens: DataFrame, support: int = SUPPORT, purity: tuple[int, int] = PURITY) -> DataFrame:
    """One row a side: tried, resolved, right: sure tokens judged by their neighbours' votes without their own. The
    own vote is subtracted from the counts; nothing is recounted."""
    sure = bigrams(tokens.where("tier in (1, 2) and match_id is not null"))
    v = votes(tokens)
    total = v.groupBy("side", "a", "b").agg(F.sum("n").alias("total"))
    # Which reading wins without one's own vote depends on the truth only: one row a (pair, truth).
    truths = sure.groupBy("side", "a", "b", F.col("match_id").alias("truth")).agg(F.count(F.lit(1)).alias("tokens"))
    # The two best readings of a pair are enough: taking one vote off the truth can only bring up the second.
    w = Window.partitionBy("side", "a", "b").orderBy(F.col("n").desc(), F.col("match_id"))
    ranked = v.withColumn("r", F.row_number().over(w)).where("r <= 2")
    judged = truths.join(total, ["side", "a", "b"]).join(ranked, ["side", "a", "b"])
    judged = judged.withColumn("m", F.col("n") - F.when(F.col("match_id") == F.col("truth"), 1).otherwise(0)).where("m > 0")
    best = judged.groupBy("side", "a", "b", "truth", "tokens", "total").agg(F.min_by("match_id", F.struct(-F.col("m"), F.col("match_id"))).alias("winner"), F.max("m").alias("top"))
    ok = (F.col("total") - 1 >= support) & (F.col("top") * purity[1] >= (F.col("total") - 1) * purity[0])
    tried = truths.groupBy("side").agg(F.sum("tokens").alias("tried"))
    done = best.where(ok).groupBy("side").agg(F.sum("tokens").alias("resolved"), F.coalesce(F.sum(F.when(F.col("winner") == F.col("truth"), F.col("tokens"))), F.lit(0)).alias("right"))
    return tried.join(done, "side", "left").select("side", "tried", F.coalesce("resolved", F.lit(0)).alias("resolved"), F.coalesce("right", F.lit(0)).alias("right"))


def seed_from_witness(words: DataFrame) -> DataFrame:
    """key, form, match_id, row_id, pos of a witness's words (row_id, pos, form): an inventory for a collection without
    a curated one, in the order of first appearance."""
    rows = words.where("form is not null and form <> ''").select("row_id", "pos", "form", X.fold_key("form").alias("key"))
    first = rows.groupBy("key", "form").agg(F.min(F.struct("row_id", "pos")).alias("at"))
    return first.select("key", "form", X.stable_id("key", "form").alias("match_id"), F.col("at.row_id").alias("row_id"), F.col("at.pos").alias("pos"))


def mint(tokens: DataFrame, inv: DataFrame) -> DataFrame:
    """key, form, match_id of the marked forms among tokens (raw) that no entry has yet; freq 0 by definition."""
    marked = tokens.where(X.mark_class("raw") != "none").select(X.fold_key("raw").alias("key"), F.col("raw").alias("form")).distinct()
    return marked.join(inv.select("key", "form").distinct(), ["key", "form"], "left_anti").select("key", "form", X.stable_id("key", "form").alias("match_id"))


def repair(tokens: DataFrame, support: int = REPAIR_SUPPORT, purity: tuple[int, int] = PURITY) -> DataFrame:
    """record_id, i, was, now of a bound table: undetermined tokens of tier 2 that strong votes of their neighbours
    contradict, the left pair before the right one. tokens as for votes()."""
    said = verdicts(votes(tokens), support, purity).select("side", "a", "b", "winner")
    doubtful = tokens.where("tier = 2 and undetermined") if "undetermined" in tokens.columns else tokens.where("tier = 2")
    hit = bigrams(doubtful).join(said, ["side", "a", "b"]).where(F.col("winner") != F.col("match_id"))
    return hit.groupBy("record_id", "i", F.col("match_id").alias("was")).agg(F.min_by("winner", "side").alias("now"))


def disagreements(tokens: DataFrame) -> DataFrame:
    """raw, seen, tokens: marked words that an aligned witness marks otherwise, with their number. A fact about two
    editions, not a fault."""
    both = tokens.where(F.col("seen").isNotNull() & (X.mark_class("raw") != "none") & ~X.agrees("raw", "seen"))
    return both.groupBy("raw", "seen").agg(F.count(F.lit(1)).alias("tokens"))


def corroborated(retrieved: DataFrame, references: DataFrame, cover_ppm: int = 800_000) -> DataFrame:
    """query_id, row_no, consistent: of the queries that name rows of the witness (array refs, counted from 1) whether
    the retrieved row (row_no, from 0) is one of them, or holds so many of the query's words that it must be."""
    both = retrieved.join(references.where(F.size("refs") > 0), "query_id")
    return both.select("query_id", "row_no", (F.array_contains("refs", (F.col("row_no") + 1).cast("int")) | (F.col("coverage_ppm") >= cover_ppm)).alias("consistent"))


def score_sample(sample: DataFrame, verdicts_: DataFrame, key: str, stratum: str, right: str) -> DataFrame:
    """stratum, judged, right: a judged sample by stratum; verdicts other than yes and no are left out."""
    both = sample.join(verdicts_.select(key, right), key)
    return both.where(F.col(right).isin("yes", "no")).groupBy(stratum).agg(F.count(F.lit(1)).alias("judged"), F.count_if(F.col(right) == "yes").alias("right"))
