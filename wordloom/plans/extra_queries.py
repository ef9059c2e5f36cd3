"""Further queries: projections, seeds, repairs, analysis and markup."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom.functions import text as X
from wordloom.operators import analyse as N
from wordloom.operators import binder as B
from wordloom.operators import search as Q
from wordloom.operators import segment as S
from wordloom.plans.corpus_queries import BND, SUR, WRD, bound, entries, words
from wordloom.plans.record_queries import HEAD, OPEN
from wordloom.plans.text_queries import DEDIAC, FOLD, LET, MRK, REC, _records
from wordloom.profiles import ARABIC as A
from wordloom.session import latest_by, table
from wordloom.sources.readers import manifest

QUERIES, ORACLE = {}, {}


def add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        ORACLE[name] = sql


add(
    "carry_columns",
    lambda s, d: entries(s, d, "gloss_msa", "lemma", "overlap_score").select("match_id", X.known("gloss_msa").alias("gloss_msa"), X.known("lemma").alias("lemma"), F.floor(X.known_number("overlap_score") * 1000).cast("bigint").alias("overlap")),
    f"WITH {SUR} SELECT match_id, CASE WHEN lower(trim(gloss_msa)) NOT IN ('', 'nan', 'none', 'null') THEN gloss_msa END AS gloss_msa, CASE WHEN lower(trim(lemma)) NOT IN ('', 'nan', 'none', 'null') THEN lemma END AS lemma, CASE WHEN NOT isnan(overlap_score) THEN CAST(floor(overlap_score * 1000) AS BIGINT) END AS overlap FROM sur",
)
_latest_entries = lambda s, d: latest_by(table(s, d, "entries"), ["nodeid"], "loaded_at", ["root", "headword", "senses"])
ENT = "ent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nodeid ORDER BY loaded_at DESC NULLS LAST) rn FROM entries) WHERE rn = 1)"
add(
    "non_empty_senses",
    lambda s, d: _latest_entries(s, d).select("nodeid", F.size("senses").alias("senses"), F.size(F.filter("senses", lambda x: F.exists(x["runs"], lambda r: r["v"].rlike(r"[\p{L}\p{N}]")))).alias("told")),
    rf"WITH {ENT} SELECT nodeid, CAST(len(senses) AS INTEGER) AS senses, CAST(len(list_filter(senses, lambda x: len(list_filter(x.runs, lambda r: regexp_matches(r.v, '[\p{{L}}\p{{N}}]'))) > 0)) AS INTEGER) AS told FROM ent",
)
add(
    "vowelled_probe",
    lambda s, d: table(s, d, "witness").groupBy("edition").agg(F.bool_or(F.col("text").rlike(f"[{A.vowels}]")).alias("vowelled"), F.count_if(F.col("text").rlike(f"[{A.vowels}]")).alias("rows")),
    f"SELECT edition, bool_or(regexp_matches(text, '[{A.vowels}]')) AS vowelled, count(*) FILTER (WHERE regexp_matches(text, '[{A.vowels}]')) AS rows FROM witness GROUP BY edition",
)
add(
    "script_filter",
    lambda s, d: table(s, d, "documents").where(X.in_script("text")).groupBy("lang").agg(F.count(F.lit(1)).alias("documents")),
    f"SELECT lang, count(*) AS documents FROM documents WHERE regexp_matches(text, '[{A.letters}]') GROUP BY lang",
)
add(
    "exact_form_id",
    lambda s, d: _exact(s, d),
    f"""WITH {BND}, {SUR}, f AS (SELECT search_key, vocalized, min(match_id) form_id FROM sur WHERE search_key IS NOT NULL AND vocalized IS NOT NULL GROUP BY ALL)
SELECT record_id, i, form_id FROM (SELECT record_id, t.i AS i, t.surface AS surface, {FOLD.format('t.surface')} AS key FROM bnd0) b JOIN f ON key = search_key AND surface = vocalized""",
)


def _exact(spark, d):
    rows = latest_by(table(spark, d, "bindings"), ["record_id"], "loaded_at", ["tokens"]).select("record_id", F.explode("tokens").alias("t"))
    toks = rows.select("record_id", F.col("t.i").alias("i"), F.col("t.surface").alias("vocalized"), X.fold_key("t.surface").alias("search_key"))
    ids = entries(spark, d, "search_key", "vocalized").where("search_key is not null and vocalized is not null").groupBy("search_key", "vocalized").agg(F.min("match_id").alias("form_id"))
    return toks.join(ids, ["search_key", "vocalized"]).select("record_id", "i", "form_id")


add(
    "parse_selection",
    lambda s, d: bound(s, d).select(F.concat_ws(":", "record_id", F.col("i").cast("string")).alias("at")).select("at", X.parse_selection("at", F.lit("")).alias("x")).select("at", F.col("x.record").alias("record"), F.col("x.i").alias("i")),
    f"WITH {BND} SELECT record_id || ':' || i AS at, record_id AS record, i FROM bnd",
)
add(
    "strip_edge",
    lambda s, d: table(s, d, "witness").select("witness_id", F.posexplode(F.split("text", " ")).alias("n", "w")).select("witness_id", "n", X.strip_edge("w").alias("w")).where("w <> ''").distinct(),
    f"WITH w AS (SELECT witness_id, unnest(string_split(text, ' ')) w, generate_subscripts(string_split(text, ' '), 1) - 1 n FROM witness) SELECT DISTINCT witness_id, CAST(n AS INTEGER) AS n, regexp_replace(w, '^[^{A.letters}{A.strip}]+|[^{A.letters}{A.strip}]+$', '', 'g') AS w FROM w WHERE regexp_replace(w, '^[^{A.letters}{A.strip}]+|[^{A.letters}{A.strip}]+$', '', 'g') <> ''",
)
add(
    "human_size",
    lambda s, d: table(s, d, "documents").select("doc_id", X.human_size(F.octet_length("text")).alias("size")),
    "WITH b AS (SELECT doc_id, octet_length(encode(text)) b FROM documents) SELECT doc_id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN b // 1024 || ' KB' WHEN b IS NOT NULL THEN b // 1048576 || ' MB' END AS size FROM b",
)
add(
    "seed_inventory",
    lambda s, d: B.seed_from_witness(latest_by(table(s, d, "witness"), ["witness_id"], "loaded_at", ["text"]).select(F.col("witness_id").alias("row_id"), F.posexplode(F.transform(X.tokens_of("text"), lambda t: t["raw"])).alias("pos", "form"))),
    f"""WITH w AS (SELECT witness_id, regexp_extract_all(text, '[{A.letters}{A.strip}]+') ws FROM (SELECT *, row_number() OVER (PARTITION BY witness_id ORDER BY loaded_at DESC NULLS LAST) rn FROM witness) WHERE rn = 1),
t AS (SELECT witness_id row_id, unnest(ws) form, generate_subscripts(ws, 1) - 1 pos FROM w), k AS (SELECT {FOLD.format('form')} AS key, form, min((row_id, pos)) AS at FROM t GROUP BY ALL)
SELECT key, form, key || '#' || left(sha1(form), 6) AS match_id, at[1] AS row_id, CAST(at[2] AS INTEGER) AS pos FROM k""".replace("min((row_id, pos)) AS at", "min_by(row_id, (row_id, pos)) AS r, min_by(pos, (row_id, pos)) AS p").replace("at[1] AS row_id, CAST(at[2] AS INTEGER)", "r AS row_id, CAST(p AS INTEGER)"),
)
add(
    "minted_forms",
    lambda s, d: B.extended(B.inventory(entries(s, d, "search_key", "vocalized", "freq")), words(s, d).where(X.mark_class("raw") != "none").select("key", F.col("raw").alias("form"))).where("minted").select("key", "form", "match_id"),
    f"""WITH {WRD}, {SUR}, m AS (SELECT DISTINCT key, raw AS form FROM wrd WHERE regexp_matches(translate(raw, '{A.stretch}', ''), '[^{A.marks}][{A.marks}]')), v AS (SELECT search_key, match_id, min(vocalized) f FROM sur WHERE search_key IS NOT NULL AND match_id IS NOT NULL AND vocalized IS NOT NULL GROUP BY ALL)
SELECT key, form, key || '#' || left(sha1(form), 6) AS match_id FROM m WHERE NOT EXISTS (SELECT 1 FROM v WHERE search_key = key AND f = form)""",
)
add(
    "flagged_by_tier",
    lambda s, d: bound(s, d).join(entries(s, d, "morph_confidence"), "match_id", "left").groupBy("tier").agg(F.count(F.lit(1)).alias("tokens"), F.count_if(F.col("morph_confidence") == "low").alias("flagged")),
    f"WITH {BND}, {SUR} SELECT tier, count(*) AS tokens, count(*) FILTER (WHERE morph_confidence = 'low') AS flagged FROM bnd LEFT JOIN sur USING (match_id) GROUP BY tier",
)
_VOW = "list_transform({}, lambda m: array_to_string(list_sort(list_distinct(string_split(replace(m, 'ّ', ''), ''))), ''))"
add(
    "compatible_filter",
    lambda s, d: entries(s, d, "vocalized", "lemma").select("match_id", N.compatible("vocalized", "lemma").alias("ok")),
    f"""WITH {SUR}, c AS (SELECT match_id, coalesce({LET.format('vocalized')}, []) AS fl, coalesce({MRK.format('vocalized')}, []) AS fm, coalesce({LET.format('lemma')}, []) AS ll, coalesce({MRK.format('lemma')}, []) AS lm FROM sur),
v AS (SELECT *, {_VOW.format('fm')} AS fv, {_VOW.format('lm')} AS lv FROM c)
SELECT match_id, len(fl) = 0 OR len(ll) = 0 OR len(list_filter(range(0, len(fl) - len(ll) + 1), lambda o: len(list_filter(range(1, len(ll) + 1), lambda j: NOT (fl[o + j] = ll[j] AND contains(fm[o + j], 'ّ') = contains(lm[j], 'ّ')
AND (j = len(ll) OR fv[o + j] = '' OR lv[j] = '' OR fv[o + j] = lv[j])))) = 0)) > 0 AS ok FROM v""",
)
_MASKED = f"regexp_replace(regexp_replace(translate({FOLD.format('root')}, 'ء', 'ا'), '[^ء-ي]', '', 'g'), '[وي]', '#', 'g')"
_HID = "[" + ", ".join(f"regexp_extract(b, p || '()()()()()()()()', {i})" for i in range(1, 9)) + "]"
add(
    "recover_masked",
    lambda s, d: entries(s, d, "root", "lemma").select("match_id", N.recover_masked(F.regexp_replace(X.root_key("root"), "[وي]", "#"), "lemma").alias("root")),
    f"""WITH {SUR}, r AS (SELECT match_id, {_MASKED} AS r, regexp_replace({DEDIAC.format("coalesce(lemma, '')")}, '\\s', '', 'g') AS b FROM sur),
u AS (SELECT *, regexp_extract_all(r, '(#*[^#]|#+$)', 1) AS u FROM r),
q AS (SELECT *, '^' || array_to_string(list_transform(u, lambda x: CASE WHEN replace(x, '#', '') = '' THEN '(.*)$' ELSE '([^' || replace(x, '#', '') || ']*)' || replace(x, '#', '') END), '') AS p FROM u),
h AS (SELECT *, list_transform({_HID}, lambda x: translate(x, '{A.hamza_seats[0]}ى', '{A.hamza_seats[1]}ي')) AS h FROM q),
k AS (SELECT *, list_transform(u, lambda x, i: CASE WHEN NOT contains(x, '#') THEN x WHEN h[i] IN ('ء', 'و', 'ي') AND (i = 1 OR length(x) - length(replace(x, '#', '')) = 1) THEN repeat(h[i], length(x) - length(replace(x, '#', ''))) || replace(x, '#', '') END) AS k FROM h)
SELECT match_id, CASE WHEN NOT contains(r, '#') THEN r WHEN regexp_matches(b, p) AND len(list_filter(k, lambda x: x IS NULL)) = 0 THEN array_to_string(k, '') END AS root FROM k""",
)
add("close_paragraphs", lambda s, d: S.close_paragraphs(table(s, d, "documents"), "doc_id", "text", {"top": "^كتاب ", "sub": HEAD, "opener": OPEN, "note": r"^\[\d+\]"}).select("doc_id", "rec", "layer", "first_line", F.length("text").alias("chars"), F.length("note").alias("note")))
add("input_manifest", lambda s, d: manifest(s, d))


def parsed(spark, d):
    """Dictionary entries written as markup, with dividers, references, page breaks and stray ampersands, and read back."""
    esc = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), '"', "&quot;")
    tags = {"ar": "foreign", "i": "hi", "q": "quote"}

    def run(r):
        out = F.when(r["t"] == "ref", F.concat(F.lit('<ref target="'), esc(r["v"]), F.lit('"/>')))
        for t, tag in tags.items():
            out = out.when(r["t"] == t, F.concat(F.lit(f"<{tag}>"), esc(r["v"]), F.lit(f"</{tag}>")))
        return out.otherwise(esc(r["v"]))

    def sense(x, k):
        mark = F.concat(F.lit('<sense type="'), F.when(x["level"] == "major", "A").otherwise("B"), F.lit('" n="'), (k + 1).cast("string"), F.lit('"/><form><orth>unread</orth></form>'))
        told = F.filter(x["runs"], lambda r: F.trim(r["v"]) != "")
        return F.concat(mark, F.array_join(F.transform(F.coalesce(told, F.array().cast("array<struct<t: string, v: string>>")), run), " &<pb/> "))

    body = F.array_join(F.transform(F.filter("senses", lambda x: x.isNotNull()), sense), "")
    xml = _latest_entries(spark, d).select("nodeid", F.concat(F.lit("<entry>"), F.coalesce(body, F.lit("")), F.lit("</entry>")).alias("xml"))
    got = N.parse_markup(xml, "nodeid", "xml").select("nodeid", F.posexplode("senses").alias("sense_no", "s"))
    return got.select("nodeid", "sense_no", "s.label", "s.level", F.posexplode("s.runs").alias("run_no", "r")).select("nodeid", "sense_no", "label", "level", "run_no", "r.t", "r.v")


add(
    "parse_markup",
    parsed,
    rf"""WITH {ENT}, s AS (SELECT nodeid, unnest(list_filter(senses, lambda x: x IS NOT NULL)) AS s, generate_subscripts(list_filter(senses, lambda x: x IS NOT NULL), 1) AS k FROM ent),
r AS (SELECT nodeid, k, s.level AS lv, list_filter(s.runs, lambda r: trim(r.v) <> '') AS rs FROM s),
u AS (SELECT nodeid, k, lv, unnest(rs) AS r, generate_subscripts(rs, 1) AS p, len(rs) AS n FROM r WHERE len(rs) > 0),
e AS (SELECT nodeid, k, lv, 2 * p AS p, CASE WHEN r.t IN ('ar', 'i', 'q', 'ref') THEN r.t ELSE 't' END AS t, r.v AS v FROM u UNION ALL SELECT nodeid, k, lv, 2 * p + 1, 't', ' & ' FROM u WHERE p < n),
g AS (SELECT *, row_number() OVER (PARTITION BY nodeid, k ORDER BY p) - row_number() OVER (PARTITION BY nodeid, k, t ORDER BY p) AS g FROM e),
m AS (SELECT nodeid, k, lv, t, g, min(p) AS p, regexp_replace(string_agg(v, '' ORDER BY p), '\s+', ' ', 'g') AS v FROM g GROUP BY ALL)
SELECT nodeid, CAST(dense_rank() OVER (PARTITION BY nodeid ORDER BY k) - 1 AS INTEGER) AS sense_no, CASE WHEN lv = 'major' THEN 'A' ELSE 'B' END || k AS label, CASE WHEN lv = 'major' THEN 'major' ELSE 'sub' END AS level,
CAST(row_number() OVER (PARTITION BY nodeid, k ORDER BY p) - 1 AS INTEGER) AS run_no, t, CASE WHEN p = max(p) OVER (PARTITION BY nodeid, k) THEN rtrim(v) ELSE v END AS v FROM m""",
)
_ITEM = f"([«({{»)}}]|[{A.letters}{A.strip}]+)"
add(
    "quoted_words",
    lambda s, d: Q.quoted_words(latest_by(table(s, d, "witness"), ["witness_id"], "loaded_at", ["text"]), "witness_id", "text"),
    f"""WITH w AS (SELECT witness_id, regexp_extract_all(text, '{_ITEM}') xs FROM (SELECT *, row_number() OVER (PARTITION BY witness_id ORDER BY loaded_at DESC NULLS LAST) rn FROM witness) WHERE rn = 1),
m AS (SELECT witness_id, unnest(xs) x, generate_subscripts(xs, 1) n FROM w), t AS (SELECT *, CASE WHEN x IN ('«', '(', '{{') THEN 1 WHEN x IN ('»', ')', '}}') THEN -1 END st FROM m),
s AS (SELECT *, coalesce(sum(st) OVER o, 0) AS s, count(*) FILTER (WHERE st IS NULL) OVER o - 1 AS i FROM t WINDOW o AS (PARTITION BY witness_id ORDER BY n)), f AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY witness_id ORDER BY n)) > 0 AS inside FROM s)
SELECT witness_id, CAST(i AS INTEGER) AS i, x AS word, inside FROM f WHERE st IS NULL""",
)
