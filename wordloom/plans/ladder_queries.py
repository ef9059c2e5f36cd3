"""Queries of the binding ladder, whole and rule by rule, with their SQL.

The SQL reads the witness through runs of equal words on a diagonal, which DuckDB can express; `bind_aligned` reads it
through the longest matching blocks and has none.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom.functions import text as X
from wordloom.operators import binder as B
from wordloom.operators import lexicon as L
from wordloom.operators import retrieve as R
from wordloom.operators.ranking import global_rank
from wordloom.plans.corpus_queries import _WK, BND, SUR, WRD, _pairs, _wit, bound, entries, retrieved
from wordloom.plans.text_queries import FOLD, REC, _records
from wordloom.profiles import ARABIC as A
from wordloom.session import materialise

QUERIES, ORACLE = {}, {}


def add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        ORACLE[name] = sql


def tokens(spark, d):
    """Every word of every record with its neighbours."""
    return B.tokens_of(_records(spark, d), "id", "textraw")


def readings(spark, d):
    return B.inventory(entries(spark, d, "search_key", "vocalized", "freq", "voc_source"))


def _keys(spark, d):
    """One row a key of the readings, never broadcast: their number grows with the data, and Spark takes the size of the
    compressed file for theirs."""
    return B.keyed(readings(spark, d)).hint("merge")


def _seen(spark, d, blocks, pairs):
    """record_id, i, seen, size, ambiguous: of each word of a record the longest block that covers it (then the lower a
    and b), the witness's word there, and whether the witness's row has other forms of that key."""
    at = blocks.select("query_id", "row_id", "a", "b", F.col("size").cast("int").alias("size"), F.explode(F.sequence(F.lit(0), (F.col("size") - 1).cast("int"))).alias("k"))
    place = F.struct(-F.col("size"), F.col("a"), F.col("b"))
    one = at.groupBy("query_id", "row_id", (F.col("a") + F.col("k")).alias("i")).agg(F.min_by(F.struct((F.col("b") + F.col("k")).alias("j"), "size"), place).alias("m"))
    texts = pairs.select("query_id", "row_id", "b", "forms")
    got = one.join(texts, ["query_id", "row_id"])
    form, key = F.get("forms", F.col("m.j")), F.get("b", F.col("m.j"))
    others = F.exists(F.arrays_zip("b", "forms"), lambda x: (x["b"] == key) & (x["forms"] != form))
    return got.select(F.col("query_id").alias("record_id"), F.col("i").cast("int").alias("i"), form.alias("seen"), F.col("m.size").alias("size"), others.alias("ambiguous"))


def seen_on_diagonals(spark, d):
    pairs = materialise(_pairs(spark, d), "witness-pairs")
    return _seen(spark, d, R.diagonal_blocks(pairs, least=2), pairs)


def seen_in_blocks(spark, d):
    pairs = materialise(_pairs(spark, d), "witness-pairs")
    blocks = R.align(pairs).select("query_id", "row_id", F.explode("blocks").alias("m")).select("query_id", "row_id", "m.*")
    return _seen(spark, d, blocks, pairs)


# SQL pieces
NB = f"{WRD}, nbr AS (SELECT record_id, i, raw, key, lag(raw) OVER w AS prev_raw, lag(key) OVER w AS prev_key, lag(key, 2) OVER w AS prev2_key, lead(key) OVER w AS next_key FROM wrd WINDOW w AS (PARTITION BY record_id ORDER BY i))"
_SUM = r"coalesce(list_sum(list_transform(regexp_extract_all(voc_source, '{}[^:,]*:(\d+)', 1), lambda x: x::INT)), 0)"
INV0 = f"""inv0 AS (SELECT search_key AS key, match_id, min(vocalized) AS form, max(coalesce(freq, 0)) AS freq, coalesce(bool_or({_SUM.format('lexicon')} > {_SUM.format('aligned')}), false) AS guess, false AS minted
FROM sur WHERE search_key IS NOT NULL AND match_id IS NOT NULL AND vocalized IS NOT NULL GROUP BY 1, 2)"""
ORD = "SELECT *, row_number() OVER (PARTITION BY key ORDER BY minted, freq DESC, match_id) AS ord, count(*) OVER (PARTITION BY key) AS n FROM"
DIAG = f"""{_WK}, pr AS (SELECT query_id, row_id FROM be JOIN sz USING (query_id) JOIN sh USING (query_id) WHERE m >= 0.35 * n),
wk AS (SELECT row_id, CAST(p - 1 AS INTEGER) pb, k AS form, {FOLD.format('k')} key FROM (SELECT row_id, unnest(ks) k, generate_subscripts(ks, 1) p FROM wt)),
hd AS (SELECT query_id, row_id, i pa, pb, i - pb d FROM pr JOIN wrd ON record_id = query_id JOIN wk USING (row_id, key)), gd AS (SELECT *, pa - row_number() OVER (PARTITION BY query_id, row_id, d ORDER BY pa) g FROM hd),
bl AS (SELECT query_id, row_id, d, min(pa) AS a, min(pb) AS b, count(*) AS size FROM gd GROUP BY query_id, row_id, d, g HAVING count(*) >= 2),
cv AS (SELECT query_id, row_id, a + k AS i, min_by(b + k, (-size, a, b)) AS j, min_by(size, (-size, a, b)) AS size FROM (SELECT *, unnest(range(0, size)) AS k FROM bl) GROUP BY ALL),
many AS (SELECT row_id, key FROM wk GROUP BY 1, 2 HAVING count(DISTINCT form) > 1),
seen AS (SELECT query_id AS record_id, CAST(i AS INTEGER) AS i, form AS seen, CAST(size AS INTEGER) AS size, many.key IS NOT NULL AS ambiguous FROM cv JOIN wk ON wk.row_id = cv.row_id AND wk.pb = cv.j LEFT JOIN many ON many.row_id = wk.row_id AND many.key = wk.key)"""
MARKS = f"CASE WHEN NOT regexp_matches(translate(raw, '{A.stretch}', ''), '[^{A.marks}][{A.marks}]') THEN 'none' WHEN regexp_matches(translate(raw, '{A.stretch}', ''), '[{A.vowels}][{A.other_marks}]*$') THEN 'full' ELSE 'partial' END"
LAST = f"nullif(regexp_extract(form, '^.*([{A.vowels}])', 1), '')"


def _in(xs):
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


def _only(ends, name):
    inside = f"coalesce({LAST} IN {_in(ends)}, false)"
    return f"CASE WHEN count(*) FILTER (WHERE {inside}) = 1 THEN min(match_id) FILTER (WHERE {inside}) END AS {name}_id, min(form) FILTER (WHERE {inside}) AS {name}_form"


KEYS = f"SELECT key, max(n) AS n, count(*) FILTER (WHERE NOT minted) AS n0, min_by(match_id, ord) AS top_id, min_by(form, ord) AS top_form, min_by(guess, ord) AS top_guess, {_only(A.genitive_ends, 'gen')}, {_only(A.accusative_ends, 'acc')} FROM"
SON = f"coalesce(key IN {_in(A.son)} AND prev2_key IN {_in(A.genitive)} AND gen_id IS NOT NULL AND rid IS DISTINCT FROM gen_id, false)"
_LA, _LB = (f"regexp_extract_all(translate({c}, '{A.stretch}', ''), '([^{A.marks}])[{A.marks}]*', 1)" for c in ("raw", "worn"))
_MB = f"regexp_extract_all(translate(worn, '{A.stretch}', ''), '[^{A.marks}]([{A.marks}]*)', 1)"
LADDER = f"""tk AS (SELECT nbr.*, {MARKS} AS marks, seen, size, ambiguous FROM nbr LEFT JOIN seen USING (record_id, i)),
att AS (SELECT key, raw AS form FROM tk WHERE marks <> 'none' UNION SELECT key, seen FROM tk WHERE seen IS NOT NULL AND size >= 3),
fl AS ({ORD} (SELECT * FROM inv0 UNION ALL SELECT key, key || '#' || left(sha1(form), 6), form, 0, false, true FROM att WHERE NOT EXISTS (SELECT 1 FROM inv0 WHERE inv0.key = att.key AND inv0.form = att.form))),
ky AS ({KEYS} fl GROUP BY key), fm AS (SELECT key, form AS want, min(match_id) AS want_id FROM fl GROUP BY 1, 2),
f1 AS (SELECT tk.*, coalesce(n, 0) AS n, top_id, top_form, top_guess, gen_id, gen_form, acc_id, acc_form, want_id, CASE WHEN marks <> 'none' THEN raw ELSE seen END AS want FROM tk LEFT JOIN ky USING (key) LEFT JOIN fm ON fm.key = tk.key AND fm.want = CASE WHEN marks <> 'none' THEN raw ELSE seen END),
f2 AS (SELECT *, CASE WHEN marks <> 'none' THEN 0 WHEN n = 0 THEN 5 WHEN n = 1 THEN 1 WHEN want_id IS NOT NULL THEN 2 END AS t0, CASE WHEN marks <> 'none' THEN want_id WHEN n = 1 THEN top_id WHEN n > 1 THEN want_id END AS rid,
CASE WHEN marks <> 'none' THEN want WHEN n = 1 THEN top_form WHEN n > 1 AND want_id IS NOT NULL THEN want END AS rform FROM f1),
su AS (SELECT *, coalesce(t0 = 2 AND size <= 2 AND ambiguous, false) AS undetermined, CASE WHEN {SON} THEN 3 ELSE t0 END AS t1, CASE WHEN {SON} THEN gen_id ELSE rid END AS id1, CASE WHEN {SON} THEN gen_form ELSE rform END AS form1 FROM f2),
vt AS (SELECT side, a, b, match_id, count(*) n FROM (SELECT 'L' side, prev_key a, key b, id1 match_id, t1, undetermined FROM su WHERE prev_key IS NOT NULL UNION ALL SELECT 'R', key, next_key, id1, t1, undetermined FROM su WHERE next_key IS NOT NULL) WHERE t1 IN (1, 2) AND match_id IS NOT NULL AND NOT undetermined GROUP BY ALL),
ve AS (SELECT side, a, b, min_by(match_id, (-n, match_id)) AS winner, sum(n) AS total FROM vt GROUP BY ALL HAVING sum(n) >= 4 AND max(n) * 10 >= sum(n) * 9),
vn AS (SELECT ve.*, min(form) AS wform FROM ve JOIN fl ON fl.match_id = winner AND fl.key = CASE side WHEN 'L' THEN b ELSE a END GROUP BY ALL),
ju AS (SELECT su.*, l.winner AS lid, l.wform AS lform, l.total AS ltotal, r.winner AS rid2, r.wform AS rform2, r.total AS rtotal FROM su LEFT JOIN vn l ON l.side = 'L' AND l.a = prev_key AND l.b = key LEFT JOIN vn r ON r.side = 'R' AND r.a = key AND r.b = next_key),
rp AS (SELECT *, CASE WHEN undetermined AND t1 = 2 AND ltotal >= 20 AND lid <> id1 THEN 'L' WHEN undetermined AND t1 = 2 AND rtotal >= 20 AND rid2 <> id1 THEN 'R' END AS fix,
CASE WHEN lid IS NOT NULL THEN 'L' WHEN rid2 IS NOT NULL THEN 'R' WHEN prev_key IN {_in(A.genitive)} AND gen_id IS NOT NULL THEN 'G' WHEN prev_key IN {_in(A.accusative)} AND acc_id IS NOT NULL THEN 'A' ELSE 'T' END AS pick FROM ju),
la AS (SELECT *, CASE WHEN fix IS NOT NULL THEN 3 WHEN t1 IS NULL THEN CASE WHEN pick = 'T' THEN 4 ELSE 3 END ELSE t1 END AS tier,
CASE WHEN fix = 'L' THEN lid WHEN fix = 'R' THEN rid2 WHEN t1 IS NULL THEN CASE pick WHEN 'L' THEN lid WHEN 'R' THEN rid2 WHEN 'G' THEN gen_id WHEN 'A' THEN acc_id ELSE top_id END ELSE id1 END AS match_id,
CASE WHEN fix = 'L' THEN lform WHEN fix = 'R' THEN rform2 WHEN t1 IS NULL THEN CASE pick WHEN 'L' THEN lform WHEN 'R' THEN rform2 WHEN 'G' THEN gen_form WHEN 'A' THEN acc_form ELSE top_form END ELSE form1 END AS rf FROM rp),
wo AS (SELECT *, CASE WHEN tier = 1 AND size >= 3 AND seen IS NOT NULL THEN seen ELSE coalesce(rf, raw) END AS worn FROM la)"""
SHOWN = f"""SELECT record_id, i, key, match_id, CAST(tier AS INTEGER) AS tier, CASE tier WHEN 0 THEN 'source' WHEN 1 THEN 'unique' WHEN 2 THEN 'aligned' WHEN 5 THEN 'unbound' ELSE 'heuristic' END AS binding,
CASE WHEN tier = 0 AND marks = 'partial' THEN 'medium' WHEN tier = 1 AND top_guess THEN 'medium' WHEN tier <= 2 THEN 'high' WHEN tier = 3 THEN 'medium' WHEN tier = 4 THEN 'low' ELSE 'none' END AS confidence, match_id IS NOT NULL AS clickable,
CASE WHEN tier = 0 THEN raw WHEN len({_LA}) = len({_LB}) THEN array_to_string(list_transform(range(1, len({_LA}) + 1), lambda k: CASE WHEN {_LA}[k] = {_LB}[k] THEN {_LA}[k] || {_MB}[k] ELSE {_LA}[k] END), '') ELSE raw END AS surface, undetermined FROM wo"""

add("bind_tokens", lambda s, d: B.bind(tokens(s, d), readings(s, d), witnessed=seen_on_diagonals(s, d)), f"WITH {NB}, {SUR}, {INV0}, {DIAG}, {LADDER} {SHOWN}")
add(
    "bind_strict",
    lambda s, d: B.bind(tokens(s, d), readings(s, d), witnessed=seen_on_diagonals(s, d), strict=True),
    f"WITH {NB}, {SUR}, {INV0}, {DIAG}, {LADDER.replace('coalesce(n, 0) AS n,', 'coalesce(CASE WHEN n0 = 1 THEN 1 ELSE n END, 0) AS n,')} {SHOWN}",
)
add("bind_aligned", lambda s, d: B.bind(tokens(s, d), readings(s, d), witnessed=seen_in_blocks(s, d)))
add(
    "candidate_join",
    lambda s, d: tokens(s, d).groupBy("key").agg(F.count(F.lit(1)).alias("uses")).join(readings(s, d), "key", "left").select("key", "uses", "match_id", "form", "ord", F.coalesce("n", F.lit(0)).alias("candidates")),
    f"WITH {WRD}, {SUR}, {INV0}, o AS ({ORD} inv0), u AS (SELECT key, count(*) AS uses FROM wrd GROUP BY key) SELECT u.key AS key, uses, match_id, form, CAST(ord AS INTEGER) AS ord, coalesce(n, 0) AS candidates FROM u LEFT JOIN o USING (key)",
)
add(
    "witness_disagreement",
    lambda s, d: B.disagreements(tokens(s, d).join(seen_on_diagonals(s, d), ["record_id", "i"])),
    f"""WITH {NB}, {DIAG}, m AS (SELECT raw, seen FROM nbr JOIN seen USING (record_id, i) WHERE {MARKS} <> 'none'),
c AS (SELECT *, regexp_extract_all(translate(raw, '{A.stretch}', ''), '([^{A.marks}])[{A.marks}]*', 1) la, regexp_extract_all(translate(seen, '{A.stretch}', ''), '([^{A.marks}])[{A.marks}]*', 1) lb,
list_transform(regexp_extract_all(translate(raw, '{A.stretch}', ''), '[^{A.marks}]([{A.marks}]*)', 1), lambda x: list_sort(list_distinct(string_split(x, '')))) ma, list_transform(regexp_extract_all(translate(seen, '{A.stretch}', ''), '[^{A.marks}]([{A.marks}]*)', 1), lambda x: list_sort(list_distinct(string_split(x, '')))) mb FROM m)
SELECT raw, seen, count(*) AS tokens FROM c WHERE NOT (la = lb AND ma = mb) GROUP BY raw, seen""",
)
# The test data's names have no "son of": here every word but a particle takes the case of the word before it.
add(
    "lag2_override",
    lambda s, d: B.override(tokens(s, d).join(_keys(s, d), "key").withColumns({"tier": F.lit(4), "reading": F.col("top")}), follows=~F.col("key").isin(*A.genitive)).where("tier = 3").select("record_id", "i", "key", F.col("reading.id").alias("match_id")),
    f"""WITH {NB}, {SUR}, {INV0}, o AS ({ORD} inv0), ky AS ({KEYS} o GROUP BY key) SELECT record_id, i, key, gen_id AS match_id FROM nbr JOIN ky USING (key)
WHERE key NOT IN {_in(A.genitive)} AND prev2_key IN {_in(A.genitive)} AND gen_id IS NOT NULL AND gen_id <> top_id""",
)
add(
    "case_agreement",
    lambda s, d: B.last_tiers(
        tokens(s, d).join(_keys(s, d), "key").where("n > 1").withColumns({"tier": F.lit(None).cast("int"), "reading": F.lit(None).cast("struct<id: string, form: string>"), "left": F.lit(None).cast("struct<id: string, form: string, total: bigint>"), "right": F.lit(None).cast("struct<id: string, form: string, total: bigint>")})
    ).select("record_id", "i", "tier", F.col("reading.id").alias("match_id")),
    f"""WITH {NB}, {SUR}, {INV0}, o AS ({ORD} inv0), ky AS ({KEYS} o GROUP BY key), g AS (SELECT *, CASE WHEN prev_key IN {_in(A.genitive)} THEN gen_id WHEN prev_key IN {_in(A.accusative)} THEN acc_id END AS c FROM nbr JOIN ky USING (key) WHERE n > 1)
SELECT record_id, i, CAST(CASE WHEN c IS NULL THEN 4 ELSE 3 END AS INTEGER) AS tier, coalesce(c, top_id) AS match_id FROM g""",
)
# The review list: the readings that the latest deliveries bind a word to as it is written.
_review = lambda s, d: bound(s, d).where("tier in (1, 2)").join(entries(s, d, "vocalized"), "match_id").select("raw", F.col("vocalized").alias("form")).where("form is not null").distinct()
REV = f"rv AS (SELECT DISTINCT raw, vocalized AS form, {FOLD.format('raw')} AS key FROM bnd JOIN sur USING (match_id) WHERE tier IN (1, 2) AND vocalized IS NOT NULL)"
add(
    "plausible_choice",
    lambda s, d: B.plausible(readings(s, d), _review(s, d)).select("key", "raw", F.col("allowed.id").alias("match_id")),
    f"WITH {BND}, {SUR}, {INV0}, o AS ({ORD} inv0), {REV} SELECT key, raw, min_by(match_id, ord) AS match_id FROM rv JOIN o USING (key, form) GROUP BY key, raw",
)
_ladder = lambda s, d: bound(s, d).withColumns({"marks": X.mark_class("raw"), "reading": F.when(F.col("match_id").isNotNull(), F.struct(F.col("match_id").alias("id"), F.lit(None).cast("string").alias("form")))})
add(
    "partial_rescue",
    lambda s, d: B.rescued(_ladder(s, d).withColumns({"raw": F.concat("raw", F.lit("ّ")), "marks": X.mark_class(F.concat("raw", F.lit("ّ")))})).groupBy("tier", "marks").agg(F.count(F.lit(1)).alias("tokens")),
    f"WITH {BND}, m AS (SELECT tier, {MARKS.replace('raw', chr(40) + 'raw || ' + repr('ّ') + chr(41))} AS marks FROM bnd) SELECT CAST(CASE WHEN tier IN (4, 5) AND marks = 'partial' THEN 0 ELSE tier END AS INTEGER) AS tier, marks, count(*) AS tokens FROM m GROUP BY ALL",
)
add(
    "late_mint",
    lambda s, d: B.late_minted(_ladder(s, d), entries(s, d, "unvocalized", "lemma").where("lemma is not null").select(F.col("unvocalized").alias("form"))).where("tier = 5").groupBy("raw", F.col("reading.id").alias("match_id")).agg(F.count(F.lit(1)).alias("tokens")),
    f"""WITH {BND}, {SUR}, a AS (SELECT DISTINCT unvocalized AS raw, true AS known FROM sur WHERE lemma IS NOT NULL AND unvocalized IS NOT NULL)
SELECT raw, coalesce(match_id, CASE WHEN known THEN key || '#' || left(sha1(raw), 6) END) AS match_id, count(*) AS tokens FROM bnd LEFT JOIN a USING (raw) WHERE tier = 5 GROUP BY ALL""",
)
RULES = [("ما", "مَا", None, 2), ("ما", "مَّا", "قال", 1), ("في", "فِي", None, 3), ("من", "مَنْ", "هو", 4), ("من", "مِنْ", None, 5)]
_VALUES = "ru(key, form, after, place) AS (VALUES " + ", ".join(f"('{k}', '{f}', {'NULL' if a is None else repr(a)}, {p})" for k, f, a, p in RULES) + ")"
add(
    "hand_corrections",
    lambda s, d: B.corrected(
        tokens(s, d).withColumns({"tier": F.lit(4), "reading": F.lit(None).cast("struct<id: string, form: string>")}), readings(s, d),
        by_token=_records(s, d).select(F.col("id").alias("record_id"), F.lit(0).alias("i"), F.lit("وَ").alias("form")).where("record_id like '%0'"), by_form=s.createDataFrame(RULES, "key string, form string, after string, place int"),
    ).where("fixed").select("record_id", "i", "tier", F.col("reading.id").alias("match_id")),
    f"""WITH {NB}, {SUR}, {INV0}, {_VALUES}, kn AS (SELECT key, form, min(match_id) AS known FROM inv0 GROUP BY ALL), rk AS (SELECT ru.*, coalesce(known, ru.key || '#' || left(sha1(ru.form), 6)) AS id FROM ru LEFT JOIN kn USING (key, form)),
bt AS (SELECT nbr.record_id, nbr.i, coalesce(known, nbr.key || '#' || left(sha1('وَ'), 6)) AS id FROM nbr LEFT JOIN kn ON kn.key = nbr.key AND kn.form = 'وَ' WHERE i = 0 AND record_id LIKE '%0'),
bf AS (SELECT record_id, i, min_by(id, place) AS id FROM nbr JOIN rk ON rk.key = nbr.key AND (after IS NULL OR after = prev_raw) GROUP BY ALL)
SELECT record_id, i, CAST(1 AS INTEGER) AS tier, coalesce(bt.id, bf.id) AS match_id FROM bt FULL JOIN bf USING (record_id, i)""",
)
add(
    "tier_availability",
    lambda s, d: s.createDataFrame([(n, t in r.available()) for n, r in (("marks", B.Resources(inventory=False)), ("inventory", B.Resources()), ("witness", B.Resources(witness=True))) for t, n in [(t, n) for t, *_ in B.TIERS]], "upto string, available boolean").groupBy("upto").agg(F.count_if("available").alias("tiers")),
    "SELECT * FROM (VALUES ('marks', 2::BIGINT), ('inventory', 5), ('witness', 6)) t(upto, tiers)",
)
_HITS = f"{WRD}, {_WK}, ht AS (SELECT query_id, row_id, CAST(m * 1000000 // n AS BIGINT) AS ppm, m >= 0.35 * n AS accepted FROM be JOIN sz USING (query_id) JOIN sh USING (query_id))"


def _stats(s, d):
    got = materialise(retrieved(s, d), "retrieved")
    asked = _records(s, d).where(F.col("layer").isin("matn", "zawaid") & (F.size(X.tokens_of("textraw")) > 0))
    one = asked.select(F.col("id").alias("query_id")).join(got, "query_id", "left").select(F.when(F.col("row_id").isNull(), "no_row").when(F.col("accepted"), "accepted").otherwise("low_coverage").alias("outcome"), "coverage_ppm")
    counts = one.groupBy("outcome").agg(F.count(F.lit(1)).alias("queries"))
    middle = L.upper_median(one.where("outcome = 'accepted'"), "coverage_ppm").select(F.lit("accepted").alias("outcome"), F.col("median").alias("coverage_median"))
    return counts.join(middle, "outcome", "left")


add(
    "retrieval_stats",
    _stats,
    f"""WITH {_HITS}, oc AS (SELECT CASE WHEN ht.query_id IS NULL THEN 'no_row' WHEN accepted THEN 'accepted' ELSE 'low_coverage' END AS outcome, ppm FROM (SELECT DISTINCT record_id FROM wrd WHERE layer IN ('matn', 'zawaid')) LEFT JOIN ht ON query_id = record_id),
md AS (SELECT ppm FROM (SELECT ppm, row_number() OVER (ORDER BY ppm) - 1 AS r, count(*) OVER () AS c FROM oc WHERE outcome = 'accepted') WHERE r = c // 2)
SELECT outcome, count(*) AS queries, CASE WHEN outcome = 'accepted' THEN (SELECT ppm FROM md) END AS coverage_median FROM oc GROUP BY outcome""",
)


def _references(s, d):
    numbered = global_rank(_wit(s, d).select("row_id"), [F.col("row_id").asc()], "row_no").withColumn("row_no", F.col("row_no") - 1)
    refs = _records(s, d).select(F.col("id").alias("query_id"), F.col("crossrefs").cast("array<int>").alias("refs"))
    return B.corroborated(retrieved(s, d).where("accepted").join(numbered, "row_id"), refs)


add(
    "reference_check",
    _references,
    f"""WITH {_HITS}, no AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS row_no FROM (SELECT DISTINCT row_id FROM wt))
SELECT query_id, row_no, list_contains(crossrefs, CAST(row_no + 1 AS INTEGER)) OR ppm >= 800000 AS consistent FROM ht JOIN no USING (row_id) JOIN rec ON id = query_id WHERE accepted AND len(crossrefs) > 0""",
)
add(
    "set_coverage",
    lambda s, d: _pairs(s, d).select("query_id", "row_id", F.floor(F.size(F.array_intersect("a", "b")) * 1_000_000 / F.size(F.array_distinct("a"))).cast("bigint").alias("coverage_ppm")),
    f"WITH {_HITS} SELECT query_id, row_id, ppm AS coverage_ppm FROM ht WHERE accepted",
)
_nbd = lambda s, d: B.with_neighbours(bound(s, d))
add(
    "consistency_repair",
    lambda s, d: B.repair(_nbd(s, d), support=5),
    f"""WITH {BND}, nb AS (SELECT *, lag(key) OVER (PARTITION BY record_id ORDER BY i) prev_key, lead(key) OVER (PARTITION BY record_id ORDER BY i) next_key FROM bnd),
bg AS (SELECT record_id, i, tier, match_id, 'L' side, prev_key a, key b FROM nb WHERE prev_key IS NOT NULL UNION ALL SELECT record_id, i, tier, match_id, 'R', key, next_key FROM nb WHERE next_key IS NOT NULL),
vt AS (SELECT side, a, b, match_id, count(*) n FROM bg WHERE tier IN (1, 2) AND match_id IS NOT NULL GROUP BY ALL), ver AS (SELECT side, a, b, min_by(match_id, (-n, match_id)) winner FROM vt GROUP BY ALL HAVING sum(n) >= 5 AND max(n) * 10 >= sum(n) * 9)
SELECT record_id, i, match_id AS was, min_by(winner, side) AS now FROM bg JOIN ver USING (side, a, b) WHERE tier = 2 AND winner <> match_id GROUP BY ALL""",
)
add(
    "frequency_holdout",
    lambda s, d: bound(s, d).where("tier in (1, 2) and match_id is not null").join(B.keyed(readings(s, d)), "key", "left").groupBy("tier").agg(F.count(F.lit(1)).alias("tried"), F.count_if(F.col("n") > 1).alias("resolved"), F.count_if((F.col("n") > 1) & (F.col("top.id") == F.col("match_id"))).alias("right")),
    f"WITH {BND}, {SUR}, {INV0}, o AS ({ORD} inv0), ky AS ({KEYS} o GROUP BY key) SELECT tier, count(*) AS tried, count(*) FILTER (WHERE n > 1) AS resolved, count(*) FILTER (WHERE n > 1 AND top_id = match_id) AS \"right\" FROM bnd LEFT JOIN ky USING (key) WHERE tier IN (1, 2) AND match_id IS NOT NULL GROUP BY tier",
)
add(
    "verdict_join",
    lambda s, d: B.score_sample(bound(s, d).select(F.concat_ws(":", "record_id", "i").alias("token"), F.col("tier").cast("string").alias("stratum")), bound(s, d).select(F.concat_ws(":", "record_id", "i").alias("token"), F.when(F.col("confidence") == "high", "yes").when(F.col("confidence") == "low", "no").otherwise("unsure").alias("verdict")), "token", "stratum", "verdict"),
    f"WITH {BND} SELECT CAST(tier AS VARCHAR) AS stratum, count(*) AS judged, count(*) FILTER (WHERE confidence = 'high') AS \"right\" FROM bnd WHERE confidence IN ('high', 'low') GROUP BY tier",
)
