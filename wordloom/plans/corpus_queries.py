"""Queries over the token table, the lexicon and the binder, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom.functions import text as X
from wordloom.operators import binder as B
from wordloom.operators import lexicon as L
from wordloom.operators import merge as M
from wordloom.operators import retrieve as R
from wordloom.operators import search as S
from wordloom.plans.text_queries import FOLD, REC, TOK, _records
from wordloom.profiles import ARABIC as A
from wordloom.session import latest_by, materialise, table

QUERIES, ORACLE = {}, {}


def add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        ORACLE[name] = sql


def words(spark, d):
    """corpus, record_id, layer, seq, i, raw, after, key: every word of every record."""
    rows = _records(spark, d).select("corpus", F.col("id").alias("record_id"), "layer", "seq", F.posexplode(X.tokens_of("textraw")).alias("i", "t"))
    return rows.select("corpus", "record_id", "layer", "seq", "i", F.col("t.raw").alias("raw"), F.col("t.after").alias("after"), X.fold_key("t.raw").alias("key"))


def bound(spark, d):
    """record_id, corpus, i, raw, match_id, binding, confidence, clickable, tier, key: the delivered bindings."""
    rows = latest_by(table(spark, d, "bindings"), ["record_id"], "loaded_at", ["corpus", "tokens"])
    rows = rows.select("record_id", "corpus", F.explode("tokens").alias("t"))
    return rows.select("record_id", "corpus", F.col("t.i").alias("i"), F.col("t.raw").alias("raw"), F.col("t.matchid").alias("match_id"), "t.binding", "t.confidence", "t.clickable", "t.tier", X.fold_key("t.raw").alias("key"))


def entries(spark, d, *cols):
    """Of a match_id the latest row."""
    return latest_by(table(spark, d, "surface"), ["match_id"], "loaded_at", list(cols))


KEY = FOLD.format("raw")
WRD = f"{REC}, {TOK}, wrd AS (SELECT *, id AS record_id, {KEY} AS key FROM tok)"
BND = f"""bnd0 AS (SELECT record_id, corpus, unnest(tokens) t FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY loaded_at DESC NULLS LAST) rn FROM bindings) WHERE rn = 1),
bnd AS (SELECT record_id, corpus, t.i AS i, t.raw AS raw, t.matchid AS match_id, t.binding AS binding, t.confidence AS confidence, t.clickable AS clickable, t.tier AS tier, {FOLD.format('t.raw')} AS key FROM bnd0)"""
SUR = "sur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY loaded_at DESC NULLS LAST) rn FROM surface) WHERE rn = 1)"

# Statistics
add(
    "word_stats",
    lambda s, d: L.word_stats(words(s, d), ["corpus", "key"]),
    f"WITH {WRD} SELECT corpus, key, count(*) AS freq, count(DISTINCT record_id) AS doc_freq, min_by(record_id, (seq, record_id)) AS first_record FROM wrd GROUP BY corpus, key",
)
add(
    "word_stats_split",
    lambda s, d: L.word_stats(words(s, d), ["key"]).select("key", "first_record"),
    f"WITH {WRD} SELECT key, min_by(record_id, (seq, record_id)) AS first_record FROM wrd GROUP BY key",
)
add(
    "layer_freqs",
    lambda s, d: words(s, d).groupBy("key").agg(F.count_if(F.col("layer") == "matn").alias("matn"), F.count_if(F.col("layer") == "zawaid").alias("zawaid"), F.count_if(F.col("layer").startswith("heading")).alias("headings")),
    f"WITH {WRD} SELECT key, count(*) FILTER (WHERE layer = 'matn') AS matn, count(*) FILTER (WHERE layer = 'zawaid') AS zawaid, count(*) FILTER (WHERE layer LIKE 'heading%') AS headings FROM wrd GROUP BY key",
)
add(
    "freq_rank",
    lambda s, d: L.freq_rank(materialise(L.word_stats(words(s, d), ["key"]).select("key", "freq"), "stats"), "key"),
    f"""WITH {WRD}, c AS (SELECT key, count(*) freq FROM wrd GROUP BY key), r AS (SELECT *, row_number() OVER (ORDER BY freq DESC, key) AS rank, sum(freq) OVER () t FROM c)
SELECT key, freq, rank, CAST(freq * 1000000 // t AS BIGINT) AS share_ppm, CAST(sum(freq) OVER (ORDER BY rank) * 1000000 // t AS BIGINT) AS cum_ppm,
CASE WHEN rank <= 50 THEN 'top50' WHEN freq = 1 THEN 'hapax' WHEN freq >= 100 THEN 'frequent' ELSE 'plain' END AS frame FROM r""",
)
add(
    "bound_stats",
    lambda s, d: bound(s, d).where("match_id is not null").groupBy("match_id", "record_id").agg(F.count(F.lit(1)).alias("n")).groupBy("match_id").agg(F.sum("n").alias("bound_freq"), F.count(F.lit(1)).alias("bound_docs")),
    f"WITH {BND} SELECT match_id, count(*) AS bound_freq, count(DISTINCT record_id) AS bound_docs FROM bnd WHERE match_id IS NOT NULL GROUP BY match_id",
)
add(
    "idf_table",
    lambda s, d: L.idf_table(words(s, d), _records(s, d).agg(F.count(F.lit(1)).alias("n")).scalar()),
    f"WITH {WRD}, c AS (SELECT key, count(DISTINCT record_id) df FROM wrd GROUP BY key) SELECT key, df, CAST(round(ln((SELECT count(*) FROM rec) / df) * 1000000) AS BIGINT) AS idf FROM c",
)
add(
    "postings",
    lambda s, d: L.postings(words(s, d), 400).select("key", "df", F.array_join("records", " ").alias("records")),
    f"WITH {WRD} SELECT key, count(DISTINCT record_id) AS df, string_agg(DISTINCT record_id, ' ' ORDER BY record_id) AS records FROM wrd GROUP BY key HAVING count(DISTINCT record_id) <= 400",
)
add(
    "inverted_index",
    lambda s, d: L.inverted_index(words(s, d)).select("corpus", "key", "seq", "delta", F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions")),
    f"""WITH {WRD}, g AS (SELECT corpus, key, seq, string_agg(i::VARCHAR, ',' ORDER BY i) positions FROM wrd GROUP BY ALL)
SELECT corpus, key, seq, seq - lag(seq, 1, 0) OVER (PARTITION BY corpus, key ORDER BY seq) AS delta, positions FROM g""",
)
add(
    "weighted_coverage",
    lambda s, d: L.weighted_coverage(entries(s, d, "freq", "root", "lemma", "gloss_msa", "lane_root"), "freq", ["root", "lemma", "gloss_msa", "lane_root"]),
    f"WITH {SUR} " + " UNION ALL ".join(f"SELECT '{f}' AS field, count({f}) AS types, CAST(coalesce(sum(freq) FILTER (WHERE {f} IS NOT NULL), 0) AS BIGINT) AS weight_with, CAST(sum(freq) AS BIGINT) AS weight_all FROM sur" for f in ("root", "lemma", "gloss_msa", "lane_root")),
)
add(
    "ambiguity",
    lambda s, d: L.ambiguity(entries(s, d, "search_key", "vocalized", "freq").where("search_key is not null and vocalized is not null"), "search_key", "vocalized", "freq"),
    f"""WITH {SUR}, p AS (SELECT search_key, vocalized, sum(coalesce(freq, 0)) w FROM sur WHERE search_key IS NOT NULL AND vocalized IS NOT NULL GROUP BY ALL), k AS (SELECT search_key, count(*) f, sum(w) w, max(w) t FROM p GROUP BY 1)
SELECT count(*) AS keys, count(*) FILTER (WHERE f >= 2) AS ambiguous, CAST(coalesce(sum(w) FILTER (WHERE f >= 2), 0) AS BIGINT) AS ambiguous_weight, CAST(sum(w) AS BIGINT) AS weight, CAST(sum(t) AS BIGINT) AS ceiling FROM k""",
)
add(
    "distribution",
    lambda s, d: entries(s, d, "divergence", "freq").groupBy("divergence").agg(F.count(F.lit(1)).alias("types"), F.coalesce(F.sum("freq"), F.lit(0)).alias("weight")),
    f"WITH {SUR} SELECT divergence, count(*) AS types, CAST(coalesce(sum(freq), 0) AS BIGINT) AS weight FROM sur GROUP BY divergence",
)
add(
    "upper_median",
    lambda s, d: L.upper_median(_records(s, d), "tokens"),
    f"WITH {REC}, l AS (SELECT list_sort(list(tokens)) l FROM rec WHERE tokens IS NOT NULL) SELECT CAST(len(l) AS BIGINT) AS n, l[len(l) // 2 + 1] AS median, l[len(l) * 95 // 100 + 1] AS p95, l[-1] AS largest FROM l",
)
add(
    "keyword_rank",
    lambda s, d: keyword_rank(entries(s, d, "lane_root", "classical_keywords")),
    rf"""WITH {SUR}, k AS (SELECT lane_root, unnest(list_transform(string_split_regex(classical_keywords, '[,;]'), lambda x: lower(trim(x)))) kw, generate_subscripts(string_split_regex(classical_keywords, '[,;]'), 1) p FROM sur WHERE lane_root IS NOT NULL AND classical_keywords IS NOT NULL),
u AS (SELECT lane_root, kw, min(p) p FROM k WHERE length(kw) > 2 GROUP BY ALL), f AS (SELECT kw, count(*) df FROM u GROUP BY kw), r AS (SELECT lane_root, kw, df, row_number() OVER (PARTITION BY lane_root ORDER BY df, p, kw) AS place FROM u JOIN f USING (kw)) SELECT lane_root, kw, df, CAST(place AS INTEGER) AS place FROM r WHERE place <= 14""",
)
add(
    "fd_conflicts",
    lambda s, d: entries(s, d, "lane_root", "classical_keywords").where("lane_root is not null and classical_keywords is not null").select("lane_root", "classical_keywords").distinct().groupBy("lane_root").agg(F.count(F.lit(1)).alias("payloads")).where("payloads > 1"),
    f"WITH {SUR} SELECT lane_root, count(DISTINCT classical_keywords) AS payloads FROM sur WHERE lane_root IS NOT NULL GROUP BY lane_root HAVING count(DISTINCT classical_keywords) > 1",
)


def keyword_rank(rows):
    """The 14 rarest keywords of each root: by the roots that have them, then their first place."""
    from pyspark.sql import Window

    kw = rows.where("lane_root is not null").select("lane_root", F.posexplode(F.transform(F.split("classical_keywords", "[,;]"), lambda x: F.lower(F.trim(x)))).alias("p", "kw"))
    u = kw.where(F.length("kw") > 2).groupBy("lane_root", "kw").agg(F.min("p").alias("p"))
    df = u.groupBy("kw").agg(F.count(F.lit(1)).alias("df"))
    w = Window.partitionBy("lane_root").orderBy("df", "p", "kw")
    return u.join(df, "kw").withColumn("place", F.row_number().over(w)).where("place <= 14").select("lane_root", "kw", "df", "place")


# Lookups and joins


add(
    "enrich_coalesce",
    lambda s, d: M.enrich(entries(s, d, "lane_root", "gloss_msa"), "lane_root", entries(s, d, "lane_root", "gloss_msa").where("gloss_msa is not null and lane_root is not null").groupBy("lane_root").agg(F.min("gloss_msa").alias("gloss_msa")), ["gloss_msa"], "root").select("match_id", "gloss_msa", "filled_from"),
    f"""WITH {SUR}, g AS (SELECT lane_root, min(gloss_msa) m FROM sur WHERE gloss_msa IS NOT NULL AND lane_root IS NOT NULL GROUP BY 1)
SELECT match_id, coalesce(nullif(gloss_msa, ''), m) AS gloss_msa, CASE WHEN nullif(gloss_msa, '') IS NULL AND m IS NOT NULL THEN 'root' END AS filled_from FROM sur LEFT JOIN g USING (lane_root)""",
)
add(
    "upsert_overlay",
    lambda s, d: M.overlay(table(s, d, "surface").where("corpus is not null").groupBy("match_id").agg(F.min("freq").alias("freq"), F.min("lemma").alias("lemma")), entries(s, d, "freq").where("freq >= 10"), "match_id"),
    f"""WITH {SUR}, t AS (SELECT match_id, freq FROM sur WHERE freq >= 10), b AS (SELECT match_id, min(freq) freq, min(lemma) lemma FROM surface WHERE corpus IS NOT NULL GROUP BY 1)
SELECT * FROM b WHERE match_id NOT IN (SELECT match_id FROM t) UNION ALL SELECT match_id, freq, NULL FROM t""",
)
HEADS = "hd AS (SELECT DISTINCT nodeid AS node, headword, nodenum FROM entries WHERE headword IS NOT NULL)"
_heads = lambda s, d: table(s, d, "entries").where("headword is not null").select(F.col("nodeid").alias("node"), "headword", "nodenum").distinct()
_DED, _FLD = (lambda c: f"translate({c}, '{A.strip}', '')"), (lambda c: FOLD.format(c))


add(
    "first_wins_index",
    lambda s, d: L.first_wins(
        None,
        [_heads(s, d).select(X.fold_key("headword").alias("key"), "node", F.col("nodenum").alias("ord")), table(s, d, "entries").select(F.col("nodeid").alias("node"), F.col("nodenum").alias("ord"), F.explode("forms").alias("f")).select(X.fold_key("f").alias("key"), "node", "ord")],
    ),
    f"""WITH {HEADS}, p AS (SELECT {_FLD('headword')} k, node, nodenum o, 0 p FROM hd UNION ALL SELECT {_FLD('f')}, nodeid, nodenum, 1 FROM (SELECT nodeid, nodenum, unnest(forms) f FROM entries))
SELECT k AS key, min_by(node, (p, coalesce(o, -1), node)) AS node, CAST(min(p) AS INTEGER) AS pass FROM p WHERE k IS NOT NULL AND k <> '' GROUP BY k""",
)
add(
    "orphan_check",
    lambda s, d: M.orphans(bound(s, d), table(s, d, "surface"), "match_id"),
    f"""WITH {BND} SELECT match_id, 'left' AS side FROM (SELECT DISTINCT match_id FROM bnd WHERE match_id IS NOT NULL) a WHERE match_id NOT IN (SELECT match_id FROM surface WHERE match_id IS NOT NULL)
UNION ALL SELECT match_id, 'right' FROM (SELECT DISTINCT match_id FROM surface WHERE match_id IS NOT NULL) b WHERE match_id NOT IN (SELECT match_id FROM bnd WHERE match_id IS NOT NULL)""",
)
add(
    "membership_flags",
    lambda s, d: entries(s, d, "search_key", "pos").join(entries(s, d, "search_key").where("search_key is not null").groupBy("search_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "search_key", "left").select("match_id", F.col("n").isNotNull().alias("review"), F.coalesce(F.col("pos") == "name", F.lit(False)).alias("is_name")),
    f"WITH {SUR}, k AS (SELECT search_key FROM sur WHERE search_key IS NOT NULL GROUP BY 1 HAVING count(*) > 1) SELECT match_id, coalesce(search_key IN (SELECT search_key FROM k), false) AS review, coalesce(pos = 'name', false) AS is_name FROM sur",
)
PRO, ENC = ["", "و", "ف", "ب", "ال", "وال", "بال", "فال"], ["", "ه", "ها", "هم"]
_RK = lambda c: f"regexp_replace(translate({FOLD.format(c)}, 'ء', 'ا'), '[^ء-ي]', '', 'g')"

# Search and context
TERMS = ["والمتقدمون", "ذلك", "قال"]
add(
    "search_form",
    lambda s, d: S.search_form(words(s, d), TERMS),
    f"""WITH {WRD}, h AS (SELECT record_id, min(seq) seq, count(DISTINCT key) matched, min(i) first_i FROM wrd WHERE key IN ({', '.join(map(repr, TERMS))}) GROUP BY 1), b AS (SELECT *, count(*) OVER () AS total FROM h WHERE matched = (SELECT max(matched) FROM h))
SELECT * FROM b ORDER BY seq, record_id LIMIT 40""",
)
add(
    "search_root",
    lambda s, d: S.search_root(_rooted(s, d), "هرق"),
    f"""WITH {BND}, {REC}, {SUR}, h AS (SELECT record_id, min(seq) seq, count(*) tokens, min(i) first_i FROM bnd JOIN rec ON id = record_id JOIN sur USING (match_id) WHERE {_RK('root')} = 'هرق' GROUP BY 1)
SELECT *, count(*) OVER () AS total FROM h ORDER BY seq, record_id LIMIT 40""",
)


def _rooted(spark, d):
    seqs = _records(spark, d).select(F.col("id").alias("record_id"), "seq")
    roots = entries(spark, d, "root").select("match_id", X.root_key("root").alias("root"))
    return bound(spark, d).join(seqs, "record_id").join(roots, "match_id")


add(
    "occurrences",
    lambda s, d: S.occurrences(bound(s, d).join(_records(s, d).select(F.col("id").alias("record_id"), "seq"), "record_id"), "عن#53f1e9dd", ("matn-00000047", 2)),
    f"WITH {BND}, {REC} SELECT record_id, seq, i FROM bnd JOIN rec ON id = record_id WHERE match_id = 'عن#53f1e9dd' AND NOT (record_id = 'matn-00000047' AND i = 2) ORDER BY seq, record_id, i LIMIT 24",
)
add(
    "kwic",
    lambda s, d: S.kwic(_records(s, d).select(F.col("id").alias("record_id"), F.transform(X.tokens_of("textraw"), lambda t: t["raw"]).alias("ws")), "ws", F.col("word") == "ذلك", 5),
    f"""WITH {REC}, {TOK}, a AS (SELECT id, list(raw ORDER BY i) ws FROM tok GROUP BY id) SELECT t.id AS record_id, t.i, raw AS word, array_to_string(ws[greatest(t.i - 4, 1):t.i], ' ') AS before, array_to_string(ws[t.i + 2:t.i + 6], ' ') AS after, t.i - 5 > 0 AS cut_before, t.i + 6 < len(ws) AS cut_after
FROM tok t JOIN a USING (id) WHERE raw = 'ذلك'""",
)
add(
    "quote_depth",
    lambda s, d: S.quote_depth(latest_by(table(s, d, "witness"), ["witness_id"], "loaded_at", ["text"]), "witness_id", "text"),
    """WITH w AS (SELECT witness_id, text FROM (SELECT *, row_number() OVER (PARTITION BY witness_id ORDER BY loaded_at DESC NULLS LAST) rn FROM witness) WHERE rn = 1),
m AS (SELECT witness_id, unnest(regexp_extract_all(text, '[«({»)}]')) mark, generate_subscripts(regexp_extract_all(text, '[«({»)}]'), 1) - 1 n FROM w),
s AS (SELECT *, sum(CASE WHEN mark IN ('«', '(', '{') THEN 1 ELSE -1 END) OVER (PARTITION BY witness_id ORDER BY n) s FROM m)
SELECT witness_id, CAST(n AS INTEGER) AS n, mark, CAST(s - least(0, min(s) OVER (PARTITION BY witness_id ORDER BY n)) AS BIGINT) AS depth FROM s""",
)


# Retrieval and alignment
def _wit(spark, d):
    return latest_by(table(spark, d, "witness"), ["witness_id"], "loaded_at", ["text"]).select(F.col("witness_id").alias("row_id"), F.transform(X.tokens_of("text"), lambda t: X.fold_key(t["raw"])).alias("keys"), F.transform(X.tokens_of("text"), lambda t: t["raw"]).alias("forms"))


def _rec(spark, d):
    rows = _records(spark, d).where(F.col("layer").isin("matn", "zawaid"))
    return rows.select(F.col("id").alias("query_id"), F.transform(X.tokens_of("textraw"), lambda t: X.fold_key(t["raw"])).alias("keys"))


def retrieved(spark, d):
    return R.retrieve(_rec(spark, d).select("query_id", F.explode("keys").alias("key")), _wit(spark, d).select("row_id", F.explode("keys").alias("key")))


_WK = f"""wt AS (SELECT witness_id AS row_id, regexp_extract_all(text, '[{A.letters}{A.strip}]+') ks FROM (SELECT *, row_number() OVER (PARTITION BY witness_id ORDER BY loaded_at DESC NULLS LAST) rn FROM witness) WHERE rn = 1),
r AS (SELECT DISTINCT row_id, {FOLD.format('k')} AS key FROM (SELECT row_id, unnest(ks) k FROM wt)), q AS (SELECT DISTINCT record_id AS query_id, key FROM wrd WHERE layer IN ('matn', 'zawaid')),
f AS (SELECT key, CAST(round(ln((SELECT count(DISTINCT row_id) FROM r) / count(*)) * 1000000) AS BIGINT) idf FROM r GROUP BY key HAVING count(*) <= 400),
sc AS (SELECT query_id, row_id, CAST(sum(idf) AS BIGINT) s FROM q JOIN r USING (key) JOIN f USING (key) GROUP BY ALL), be AS (SELECT query_id, min_by(row_id, (-s, row_id)) row_id, max(s) score FROM sc GROUP BY 1),
sz AS (SELECT query_id, count(*) n FROM q GROUP BY 1), sh AS (SELECT query_id, count(*) m FROM be JOIN q USING (query_id) JOIN r USING (row_id, key) GROUP BY 1)"""
add("idf_retrieve", retrieved, f"WITH {WRD}, {_WK} SELECT query_id, row_id, score, CAST(m * 1000000 // n AS BIGINT) AS coverage_ppm, m >= 0.35 * n AS accepted FROM be JOIN sz USING (query_id) JOIN sh USING (query_id)")


def _pairs(spark, d):
    hit = materialise(retrieved(spark, d).where("accepted").select("query_id", "row_id"), "retrieved")
    a, b = _rec(spark, d).withColumnRenamed("keys", "a"), _wit(spark, d).withColumnRenamed("keys", "b")
    return hit.join(a, "query_id").join(b, "row_id")


add("align_blocks", lambda s, d: R.align(_pairs(s, d)).select("query_id", "row_id", F.explode("blocks").alias("m")).select("query_id", "row_id", "m.*"))
add(
    "diagonal_blocks",
    lambda s, d: R.diagonal_blocks(_pairs(s, d)),
    f"""WITH {WRD}, {_WK}, pr AS (SELECT query_id, row_id FROM be JOIN sz USING (query_id) JOIN sh USING (query_id) WHERE m >= 0.35 * n),
wk AS (SELECT row_id, CAST(p - 1 AS INTEGER) pb, {FOLD.format('k')} key FROM (SELECT row_id, unnest(ks) k, generate_subscripts(ks, 1) p FROM wt)),
h AS (SELECT query_id, row_id, i pa, pb, i - pb d FROM pr JOIN wrd ON record_id = query_id JOIN wk USING (row_id, key)), g AS (SELECT *, pa - row_number() OVER (PARTITION BY query_id, row_id, d ORDER BY pa) g FROM h)
SELECT query_id, row_id, min(pa) AS a, min(pb) AS b, count(*) AS size FROM g GROUP BY query_id, row_id, d, g HAVING count(*) >= 3""",
)

# Binding
add(
    "morph_coverage",
    lambda s, d: bound(s, d).where("match_id is not null").join(entries(s, d, "root", "lemma"), "match_id", "left").groupBy("corpus").agg(F.count(F.lit(1)).alias("bound"), F.count("root").alias("with_root"), F.count("lemma").alias("with_lemma")),
    f"WITH {BND}, {SUR} SELECT bnd.corpus, count(*) AS bound, count(root) AS with_root, count(lemma) AS with_lemma FROM bnd LEFT JOIN sur USING (match_id) WHERE match_id IS NOT NULL GROUP BY bnd.corpus",
)
NBR = f"{BND}, nb AS (SELECT *, lag(key) OVER (PARTITION BY record_id ORDER BY i) prev_key, lead(key) OVER (PARTITION BY record_id ORDER BY i) next_key FROM bnd)"
BIG = "bg AS (SELECT record_id, i, tier, match_id, 'L' side, prev_key a, key b FROM nb WHERE prev_key IS NOT NULL UNION ALL SELECT record_id, i, tier, match_id, 'R', key, next_key FROM nb WHERE next_key IS NOT NULL), vt AS (SELECT side, a, b, match_id, count(*) n FROM bg WHERE tier IN (1, 2) AND match_id IS NOT NULL GROUP BY ALL)"
_nb = lambda s, d: B.with_neighbours(bound(s, d))
add("collocation_votes", lambda s, d: B.votes(_nb(s, d)), f"WITH {NBR}, {BIG} SELECT side, a, b, match_id, n FROM vt")
add(
    "collocation_resolve",
    lambda s, d: B.verdicts(B.votes(_nb(s, d))),
    f"WITH {NBR}, {BIG} SELECT side, a, b, min_by(match_id, (-n, match_id)) AS winner, max(n) AS top, CAST(sum(n) AS BIGINT) AS total FROM vt GROUP BY side, a, b HAVING sum(n) >= 4 AND max(n) * 10 >= sum(n) * 9",
)
add(
    "holdout_eval",
    lambda s, d: B.holdout(_nb(s, d)),
    f"""WITH {NBR}, {BIG}, tr AS (SELECT side, a, b, match_id truth, count(*) c FROM bg WHERE tier IN (1, 2) AND match_id IS NOT NULL GROUP BY ALL),
j AS (SELECT tr.*, vt.match_id m, n - CASE WHEN vt.match_id = truth THEN 1 ELSE 0 END k FROM tr JOIN vt USING (side, a, b)), t AS (SELECT side, a, b, sum(n) total FROM vt GROUP BY ALL),
w AS (SELECT side, a, b, truth, c, min_by(m, (-k, m)) w, max(k) top FROM j WHERE k > 0 GROUP BY ALL),
o AS (SELECT side, sum(c) resolved, sum(CASE WHEN w = truth THEN c ELSE 0 END) r FROM w JOIN t USING (side, a, b) WHERE total - 1 >= 4 AND top * 10 >= (total - 1) * 9 GROUP BY side), x AS (SELECT side, sum(c) tried FROM tr GROUP BY side)
SELECT side, CAST(tried AS BIGINT) AS tried, CAST(coalesce(resolved, 0) AS BIGINT) AS resolved, CAST(coalesce(r, 0) AS BIGINT) AS "right" FROM x LEFT JOIN o USING (side)""",
)
add(
    "review_enrichment",
    lambda s, d: bound(s, d).groupBy("key", "tier").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") == "low").alias("low")).groupBy("key").agg(F.min_by("tier", F.struct(-F.col("n"), F.col("tier"))).alias("modal_tier"), F.sum("n").alias("tokens"), F.sum("low").alias("low")),
    f"WITH {BND}, k AS (SELECT key, tier, count(*) n, count(*) FILTER (WHERE confidence = 'low') low FROM bnd GROUP BY ALL) SELECT key, min_by(tier, (-n, tier)) AS modal_tier, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(low) AS BIGINT) AS low FROM k GROUP BY key",
)
add(
    "wilson_interval",
    lambda s, d: bound(s, d).groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") == "high").alias("k")).select("tier", "n", "k", *[F.floor(x * 10_000).cast("bigint").alias(nm) for x, nm in zip(M.wilson(F.col("k"), F.col("n")), ("low", "high"))]),
    f"""WITH {BND}, g AS (SELECT tier, count(*) n, count(*) FILTER (WHERE confidence = 'high') k FROM bnd GROUP BY 1), p AS (SELECT *, k / n p, 1.96::DOUBLE z FROM g)
SELECT tier, n, k, CAST(floor((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n) * 10000) AS BIGINT) AS low, CAST(floor((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n) * 10000) AS BIGINT) AS high FROM p""",
)
_STRATUM = "CASE WHEN tier = 5 THEN 'unbound' WHEN tier = 4 THEN 'guess' WHEN tier = 3 THEN 'neighbour' WHEN tier = 0 THEN 'marked' WHEN confidence <> 'high' THEN 'doubtful' ELSE 'plain' END"
_strat = lambda: F.expr(_STRATUM)
add(
    "stratified_sample",
    lambda s, d: M.hash_sample(bound(s, d).select(_strat().alias("stratum"), F.concat_ws(":", "record_id", F.col("i").cast("string")).alias("token")), "stratum", "token", 20, "s1|").select("stratum", "token", "place"),
    f"WITH {BND}, t AS (SELECT {_STRATUM} stratum, record_id || ':' || i token FROM bnd) SELECT stratum, token, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('s1|' || token), token) place FROM t) WHERE place <= 20",
)
add(
    "strata",
    lambda s, d: bound(s, d).groupBy(_strat().alias("stratum")).agg(F.count(F.lit(1)).alias("tokens")),
    f"WITH {BND} SELECT {_STRATUM} AS stratum, count(*) AS tokens FROM bnd GROUP BY 1",
)
add(
    "first_n_sample",
    lambda s, d: first_n(bound(s, d)),
    f"WITH {BND} SELECT tier, record_id, i FROM (SELECT tier, record_id, i, row_number() OVER (PARTITION BY tier ORDER BY record_id, i) p FROM bnd) WHERE p <= 5",
)


def first_n(tokens):
    from pyspark.sql import Window

    w = Window.partitionBy("tier").orderBy("record_id", "i")
    return tokens.withColumn("p", F.row_number().over(w)).where("p <= 5").select("tier", "record_id", "i")


# Merging and packaging
_FIELDS = ["lemma", "root", "gloss_msa", "classical_keywords"]
add(
    "richest_wins",
    lambda s, d: M.richest(entries(s, d, "search_key", *_FIELDS), "search_key", "match_id", _FIELDS),
    f"WITH {SUR}, z AS (SELECT search_key, match_id, " + " + ".join(f"coalesce(length({f}), 0)" for f in _FIELDS) + " AS n FROM sur WHERE search_key IS NOT NULL) SELECT search_key, min_by(match_id, (-n, match_id)) AS richest, CAST(max(n) AS INTEGER) AS chars FROM z GROUP BY search_key",
)
add(
    "merge_shared",
    lambda s, d: M.merge_shared(entries(s, d, "lane_root", "corpus", "pos", "lemma", "gloss_msa").where("corpus is not null"), "lane_root", F.col("corpus"), ["pos"], ["lemma", "gloss_msa"]),
    f"""WITH {SUR}, m AS (SELECT lane_root, coalesce(min(pos) <> max(pos), false) conflict, min_by(lemma, (corpus, lemma)) FILTER (WHERE lemma IS NOT NULL) l, min_by(gloss_msa, (corpus, gloss_msa)) FILTER (WHERE gloss_msa IS NOT NULL) g FROM sur WHERE lane_root IS NOT NULL AND corpus IS NOT NULL GROUP BY 1)
SELECT lane_root, conflict, CASE WHEN NOT conflict THEN l END AS lemma, CASE WHEN NOT conflict THEN g END AS gloss_msa FROM m""",
)
add(
    "content_digest",
    lambda s, d: M.content_digest(table(s, d, "surface"), ["corpus"], ["match_id", "search_key", "vocalized", "freq"]),
    "WITH h AS (SELECT corpus, md5(concat_ws(chr(31), " + ", ".join(f"coalesce({c}::VARCHAR, chr(30))" for c in ("match_id", "search_key", "vocalized", "freq")) + ")) m FROM surface) SELECT corpus, count(*) AS rows, CAST(sum(('0x' || substr(m, 1, 12))::BIGINT) % 2305843009213693951 AS BIGINT) AS digest FROM h GROUP BY corpus",
)
add(
    "shard_plan",
    lambda s, d: M.shard_plan(entries(s, d, "search_key", "vocalized", "lemma").where("search_key is not null"), X.fnv1a("search_key"), F.coalesce(F.octet_length("vocalized"), F.lit(0)) + F.coalesce(F.octet_length("lemma"), F.lit(0)), 6000),
    f"""WITH {SUR}, h AS (SELECT list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(0, octet_length(encode(search_key))), lambda i: ('0x' || substr(hex(encode(search_key)), 2 * i + 1, 2))::BIGINT)), lambda a, b: (xor(a, b) * 16777619) & 4294967295) h,
coalesce(octet_length(encode(vocalized)), 0) + coalesce(octet_length(encode(lemma)), 0) b FROM sur WHERE search_key IS NOT NULL), n AS (SELECT unnest([1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024]) n),
s AS (SELECT n, h % n t, sum(b) b FROM h, n GROUP BY ALL), m AS (SELECT n AS shards, CAST(max(b) AS BIGINT) AS largest, max(b) <= 6000 AS fits FROM s GROUP BY n) SELECT *, shards = coalesce((SELECT min(shards) FROM m WHERE fits), -1) AS chosen FROM m""",
)
