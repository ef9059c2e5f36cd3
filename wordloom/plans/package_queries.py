"""Queries of deliveries and packaging: readers, sinks, contracts, carried columns, ranges, roots and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wordloom.functions import text as X
from wordloom.operators import lexicon as L
from wordloom.operators import merge as M
from wordloom.operators import ranges as G
from wordloom.operators import segment as S
from wordloom.operators.analyse import root_display
from wordloom.plans.corpus_queries import _RK, BND, ENC, PRO, SUR, WRD, bound, entries, words
from wordloom.plans.extra_queries import ENT
from wordloom.plans.text_queries import FOLD, REC, _records
from wordloom.profiles import ARABIC as A
from wordloom.session import latest_by, scratch, table
from wordloom.sources import readers
from wordloom.sources.contracts import DECLARED, contract
from wordloom.streaming import upsert

QUERIES, ORACLE = {}, {}


def add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        ORACLE[name] = sql


# Readers: small tables are written in the delivered form and read back.
def _marked_up(s, d):
    path = scratch(s, "texts")
    lines = F.concat_ws("\n", F.lit("######"), F.format_string("#META# share :: %s", F.col("target_share").cast("string")), F.format_string("#META# repeats :: %d", "max_repeats"), F.lit("#META# note :: NODATA"), F.lit("#META#Header#End#"), F.concat(F.lit("body of "), F.col("source")))
    table(s, d, "mix_targets").where("source is not null").select("source", lines.alias("value")).write.partitionBy("source").option("lineSep", "\r\n").text(path)
    return readers.text_files(s, f"{path}/*")


def _headers(s, d):
    got = readers.header_fields(_marked_up(s, d), "path", "header")
    return got.select(F.regexp_extract("path", "source=([^/]*)/", 1).alias("source"), "field", "value")


add("header_fields", _headers, "SELECT source, unnest(['share', 'repeats']) AS field, unnest([CAST(target_share AS VARCHAR), CAST(max_repeats AS VARCHAR)]) AS value FROM mix_targets WHERE source IS NOT NULL")
add(
    "text_bodies",
    lambda s, d: _marked_up(s, d).select(F.regexp_extract("path", "source=([^/]*)/", 1).alias("source"), F.trim(F.regexp_replace("body", r"\s+", " ")).alias("body")),
    "SELECT source, 'body of ' || source AS body FROM mix_targets WHERE source IS NOT NULL",
)


def _json_file(s, d):
    path = scratch(s, "json")
    units = F.collect_list(F.struct(F.col("max_repeats").alias("id"), F.concat(F.lit("text  of "), F.col("source")).alias("arabic")))
    # One file for each number of repeats: 14 rows of input at any scale.
    table(s, d, "mix_targets").groupBy(F.col("max_repeats").alias("file")).agg(F.to_json(F.struct(units.alias("hadiths"))).alias("value")).write.partitionBy("file").text(path)
    got = readers.json_units(s, f"{path}/*")
    return got.select("unit_no", "line")


add("json_units", _json_file, "SELECT CAST(max_repeats AS BIGINT) AS unit_no, max_repeats || ' - text of ' || source AS line FROM mix_targets WHERE source IS NOT NULL")


def _csv_file(s, d):
    path = scratch(s, "csv")
    rows = latest_by(table(s, d, "witness"), ["witness_id"], "loaded_at", ["edition", "text"])
    rows.where("text is not null").select("text", "witness_id").write.option("header", True).option("escape", '"').csv(path)
    got = readers.witness_units(s, path)
    return got.agg(F.count(F.lit(1)).alias("units"), F.count_distinct("unit_no").alias("numbers"), F.sum(F.length(F.regexp_replace("text", r"\s", ""))).alias("letters"))


add(
    "witness_units",
    _csv_file,
    r"WITH w AS (SELECT text FROM (SELECT *, row_number() OVER (PARTITION BY witness_id ORDER BY loaded_at DESC NULLS LAST) rn FROM witness) WHERE rn = 1 AND trim(text) <> '') SELECT count(*) AS units, count(*) AS numbers, CAST(sum(length(regexp_replace(text, '\s', '', 'g'))) AS BIGINT) AS letters FROM w",
)


# Sinks
def _sharded(s, d):
    path = scratch(s, "shards")
    rows = entries(s, d, "search_key", "vocalized", "corpus").where("search_key is not null").withColumn("shard", X.fnv1a("search_key") % 8)
    readers.write_shards(rows, path, "shard", parts=2)
    back = s.read.schema("match_id string, search_key string, vocalized string, corpus string").json(path)
    sizes = readers.shard_sizes(s, path, "shard").select(F.col("shard").cast("bigint").alias("shard"), (F.col("bytes") > 0).alias("filled"))
    return back.groupBy((X.fnv1a("search_key") % 8).alias("shard")).agg(F.count(F.lit(1)).alias("rows")).join(sizes, "shard")


_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(0, octet_length(encode({c}))), lambda i: ('0x' || substr(hex(encode({c})), 2 * i + 1, 2))::BIGINT)), lambda a, b: (xor(a, b) * 16777619) & 4294967295)"
add("sharded_sink", _sharded, f"WITH {SUR} SELECT {_FNV.format(c='search_key')} % 8 AS shard, count(*) AS rows, true AS filled FROM sur WHERE search_key IS NOT NULL GROUP BY 1")


def _overwritten(s, d):
    path = scratch(s, "rebuilt")
    rows = _records(s, d).select("id", "corpus", "layer", "tokens").where("corpus is not null")
    readers.write_shards(rows, path, "corpus", fmt="parquet", codec="zstd", parts=2)
    readers.write_shards(rows.where("corpus = 'misbah' and layer = 'matn'"), path, "corpus", fmt="parquet", codec="zstd")
    return s.read.parquet(path).groupBy(F.col("corpus").cast("string").alias("corpus")).agg(F.count(F.lit(1)).alias("records"))


add("partition_overwrite", _overwritten, f"WITH {REC} SELECT corpus, count(*) AS records FROM rec WHERE corpus <> 'misbah' OR layer = 'matn' GROUP BY corpus")
add(
    "record_documents",
    lambda s, d: readers.nested_records(bound(s, d), "record_id", "i", ["raw", "match_id"]).select("record_id", F.size("tokens").alias("tokens"), F.md5(F.array_join(F.transform("tokens", lambda t: F.concat_ws("|", t["i"].cast("string"), t["raw"], F.coalesce(t["match_id"], F.lit("-")))), ";")).alias("h")),
    f"WITH {BND} SELECT record_id, CAST(count(*) AS INTEGER) AS tokens, md5(string_agg(concat_ws('|', i, raw, coalesce(match_id, '-')), ';' ORDER BY i)) AS h FROM bnd GROUP BY record_id",
)
add(
    "contract_check",
    lambda s, d: s.createDataFrame([(t, len(table(s, d, t).columns), len(readers.check_contract(table(s, d, t), contract(t)))) for t in DECLARED], "table_name string, columns bigint, problems bigint"),
    "SELECT table_name, count(*) AS columns, 0::BIGINT AS problems FROM duckdb_columns() WHERE table_name IN (" + ", ".join(f"'{t}'" for t in DECLARED) + ") GROUP BY table_name",
)

# Columns that travel
_whole = lambda s, d: latest_by(table(s, d, "records"), ["id"], "loaded_at", [c for c in table(s, d, "records").columns if c not in ("id", "loaded_at")])
PUBLIC = ["id", "corpus", "record_type", "layer", "number", "displaynumber", "editionnumber", "kitab_no", "kitab_title", "bab_no", "bab_title", "pages", "textraw", "prev_id", "next_id", "curatedindex", "tokens", "note"]
add(
    "public_columns",
    lambda s, d: M.trim_payload(_whole(s, d).withColumns({"kitab_no": F.col("kitab.idx"), "kitab_title": F.col("kitab.titlear"), "bab_no": F.col("bab.idx"), "bab_title": F.col("bab.titlear"), "pages": F.array_join("pages", "|"), "note": X.known("zawaidnote")}), PUBLIC),
    f"WITH {REC} SELECT id, corpus, record_type, layer, number, displaynumber, editionnumber, kitab.idx AS kitab_no, kitab.titlear AS kitab_title, bab.idx AS bab_no, bab.titlear AS bab_title, array_to_string(pages, '|') AS pages, textraw, prev_id, next_id, curatedindex, tokens, CASE WHEN lower(trim(zawaidnote)) NOT IN ('', 'nan', 'none', 'null') THEN zawaidnote END AS note FROM rec",
)
_REFUSED = ["rank", "doc_freq", "pct", "cum_pct", "loaded_at"]
_CARRIED = [c.split()[0] for c in DECLARED["surface"].split(", ") if c.split()[0] not in _REFUSED]
add(
    "payload_trim",
    lambda s, d: M.carry(table(s, d, "surface"), _CARRIED, _REFUSED).select("match_id", F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in _CARRIED if c != "overlap_score"])).alias("h")).distinct(),
    "SELECT DISTINCT match_id, md5(concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '-')" for c in _CARRIED if c != "overlap_score") + ")) AS h FROM surface",
)
add(
    "word_facts_split",
    lambda s, d: L.word_stats(words(s, d), ["key"]).select("key", "freq", "doc_freq"),
    f"WITH {WRD} SELECT key, count(*) AS freq, count(DISTINCT record_id) AS doc_freq FROM wrd GROUP BY key",
)
_told = lambda x: F.exists(x["runs"], lambda r: r["v"].rlike(r"[\p{L}\p{N}]"))
add(
    "told_senses",
    lambda s, d: latest_by(table(s, d, "entries"), ["nodeid"], "loaded_at", ["senses"]).select("nodeid", F.posexplode(F.filter("senses", _told)).alias("place", "x")).select("nodeid", "place", "x.label", "x.level"),
    rf"WITH {ENT}, k AS (SELECT nodeid, list_filter(senses, lambda x: len(list_filter(x.runs, lambda r: regexp_matches(r.v, '[\p{{L}}\p{{N}}]'))) > 0) AS ss FROM ent) SELECT nodeid, CAST(unnest(range(0, len(ss))) AS INTEGER) AS place, unnest(ss).label AS label, unnest(ss).level AS level FROM k",
)
_used = lambda s, d: bound(s, d).where("match_id is not null").select("match_id").distinct()
add(
    "used_roots",
    lambda s, d: entries(s, d, "lane_root").where("lane_root is not null").select("lane_root").distinct().join(entries(s, d, "root").join(_used(s, d), "match_id").select(X.root_key("root").alias("lane_root")), "lane_root", "left_semi"),
    f"WITH {BND}, {SUR} SELECT DISTINCT lane_root FROM sur WHERE lane_root IN (SELECT {_RK('root')} FROM sur WHERE root IS NOT NULL AND match_id IN (SELECT match_id FROM bnd WHERE match_id IS NOT NULL))",
)


# Lookups
def _panel(s, d):
    """A word's entry with its use in the texts, the first classical keyword of its root and the root's articles: four
    left joins, each with one row a key."""
    own = entries(s, d, "search_key", "vocalized", "lane_root", "classical_keywords", "lane_entry_count")
    per = bound(s, d).where("match_id is not null").groupBy("match_id", "record_id").agg(F.count(F.lit(1)).alias("n"))
    uses = per.groupBy("match_id").agg(F.sum("n").alias("uses"), F.count(F.lit(1)).alias("records"))
    classical = own.where("lane_root is not null and classical_keywords is not null").groupBy("lane_root").agg(F.min("classical_keywords").alias("classical"))
    articles = own.where("lane_root is not null").groupBy("lane_root").agg(F.max("lane_entry_count").alias("articles"))
    rows = own.select("match_id", "search_key", "vocalized", "lane_root").join(uses, "match_id", "left").join(classical, "lane_root", "left").join(articles, "lane_root", "left")
    return rows.select("match_id", "search_key", "vocalized", F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("records", F.lit(0)).alias("records"), "classical", "articles")


add(
    "word_panel",
    _panel,
    f"""WITH {BND}, {SUR}, u AS (SELECT match_id, count(*) uses, count(DISTINCT record_id) records FROM bnd WHERE match_id IS NOT NULL GROUP BY 1), c AS (SELECT lane_root, min(classical_keywords) classical FROM sur WHERE classical_keywords IS NOT NULL AND lane_root IS NOT NULL GROUP BY 1),
a AS (SELECT lane_root, max(lane_entry_count) articles FROM sur WHERE lane_root IS NOT NULL GROUP BY 1) SELECT sur.match_id, search_key, vocalized, coalesce(uses, 0) AS uses, coalesce(records, 0) AS records, classical, articles FROM sur LEFT JOIN u USING (match_id) LEFT JOIN c USING (lane_root) LEFT JOIN a USING (lane_root)""",
)
_COLS = ("vocalized", "unvocalized", "lemma")
_KEYS = ((lambda c: F.col(c), lambda c: c), (lambda c: X.dediac(c), lambda c: f"translate({c}, '{A.strip}', '')"), (lambda c: X.fold_key(c), lambda c: FOLD.format(c)))
_heads = lambda s, d: table(s, d, "entries").where("headword is not null").select(F.col("nodeid").alias("node"), "headword").distinct()
add(
    "tiered_lookup",
    lambda s, d: L.tiered_lookup(
        entries(s, d, *_COLS), "match_id", [k(c) for k, _ in _KEYS for c in _COLS],
        [_heads(s, d).groupBy(k("headword").alias("key")).agg(F.min("node").alias("node")) for k, _ in _KEYS for _ in _COLS],
    ),
    f"""WITH {SUR}, hd AS (SELECT DISTINCT nodeid AS node, headword FROM entries WHERE headword IS NOT NULL), h AS ("""
    + " UNION ALL ".join(f"SELECT {n} g, {q('headword')} k, min(node) n FROM hd GROUP BY ALL" for n, (_, q) in enumerate(_KEYS))
    + "), q AS ("
    + " UNION ALL ".join(f"SELECT match_id, {3 * n + m} t, {n} g, {q(c)} k FROM sur" for n, (_, q) in enumerate(_KEYS) for m, c in enumerate(_COLS))
    + ") SELECT match_id, CAST(min(t) AS INTEGER) AS tier, min_by(n, (t, n)) AS node FROM q JOIN h USING (g, k) WHERE k <> '' GROUP BY match_id",
)


def _variants(s, d):
    roots = table(s, d, "surface").select("root").where("root is not null").distinct()
    tries = roots.select("root", F.posexplode(X.root_variants(X.root_key("root"))).alias("place", "spelling"))
    # A dictionary that lists doubled roots short, and final weak letters as alef maksura.
    known = table(s, d, "surface").where("lane_root is not null").select(F.regexp_replace(F.regexp_replace("lane_root", r"^(.)(.)\2$", "$1$2"), "[يو]$", "ى").alias("spelling")).distinct()
    return tries.join(known, "spelling").groupBy("root").agg(F.min_by("spelling", "place").alias("found"), F.min("place").alias("place"))


_GEM = "[r] || CASE WHEN length(r) = 3 AND r[2] = r[3] THEN [r[1:2]] ELSE [] END || CASE WHEN length(r) = 3 AND r[1] = r[2] THEN [r[2:3]] ELSE [] END"
add(
    "variant_lookup",
    _variants,
    f"""WITH k AS (SELECT DISTINCT root, {_RK('root')} AS r FROM surface WHERE root IS NOT NULL), g AS (SELECT root, {_GEM} AS g FROM k),
w AS (SELECT root, flatten(list_transform(g, lambda r: [r] || list_transform(list_filter(['ي', 'ى', 'و'], lambda b: right(r, 1) IN ('ي', 'ى', 'و') AND b <> right(r, 1)), lambda b: left(r, length(r) - 1) || b))) AS w FROM g),
v AS (SELECT root, flatten(list_transform(w, lambda r: [r] || flatten(list_transform(list_filter(range(1, length(r) + 1), lambda i: contains('{A.seats}', r[i])), lambda i: list_transform(list_filter(string_split('{A.seats}', ''), lambda s: s <> r[i]), lambda s: r[1:i - 1] || s || r[i + 1:]))))) AS v FROM w),
o AS (SELECT root, list_filter(list_filter(v, lambda x: x <> ''), lambda x, i: list_position(list_filter(v, lambda y: y <> ''), x) = i) AS o FROM v), t AS (SELECT root, unnest(o) AS spelling, unnest(range(0, len(o))) AS place FROM o),
kn AS (SELECT DISTINCT regexp_replace(CASE WHEN length(lane_root) = 3 AND lane_root[2] = lane_root[3] THEN lane_root[1:2] ELSE lane_root END, '[يو]$', 'ى') AS spelling FROM surface WHERE lane_root IS NOT NULL)
SELECT root, min_by(spelling, place) AS found, CAST(min(place) AS INTEGER) AS place FROM t JOIN kn USING (spelling) GROUP BY root""",
)
add(
    "context_override",
    lambda s, d: M.override_by_context(
        bound(s, d).join(entries(s, d, "root"), "match_id", "left").select("record_id", "i", X.root_key("root").alias("root")),
        bound(s, d).where("confidence = 'high'").join(entries(s, d, "lane_root"), "match_id").select("record_id", "i", F.col("lane_root").alias("context_root")),
        F.col("root").isNull() | (X.is_geminate("context_root") & ~X.is_geminate("root")) | (X.is_hollow("context_root") & ~X.is_hollow("root")),
    ),
    f"""WITH {BND}, {SUR}, t AS (SELECT record_id, i, {_RK('root')} AS r, CASE WHEN confidence = 'high' THEN lane_root END AS c FROM bnd LEFT JOIN sur USING (match_id)),
x AS (SELECT *, c IS NOT NULL AND coalesce(r IS NULL OR (length(c) = 3 AND c[2] = c[3] AND NOT (length(r) = 3 AND r[2] = r[3])) OR (length(c) = 3 AND c[2] IN ('و', 'ي') AND NOT (length(r) = 3 AND r[2] IN ('و', 'ي'))), false) AS take FROM t)
SELECT record_id, i, CASE WHEN take THEN c ELSE r END AS root, CASE WHEN take THEN 'context' WHEN r IS NOT NULL THEN 'entry' END AS basis FROM x""",
)
add(
    "donor_isolation",
    lambda s, d: _isolated(s, d),
    f"""WITH {SUR}, own AS (SELECT * FROM sur WHERE corpus = 'misbah' AND search_key IS NOT NULL), g AS (SELECT lane_root, min(gloss_msa) m FROM sur WHERE corpus <> 'misbah' AND lane_root IS NOT NULL AND gloss_msa IS NOT NULL GROUP BY 1)
SELECT search_key, count(*) AS candidates, count(*) FILTER (WHERE nullif(trim(gloss_msa), '') IS NULL AND m IS NOT NULL) AS filled FROM own LEFT JOIN g USING (lane_root) GROUP BY search_key""",
)


def _isolated(s, d):
    """A collection's readings filled from the others' glosses: a donor gives fields, never a reading, so the candidates
    of a key are the collection's own."""
    every = entries(s, d, "search_key", "lane_root", "gloss_msa", "corpus")
    donor = every.where("corpus <> 'misbah' and lane_root is not null and gloss_msa is not null").groupBy("lane_root").agg(F.min("gloss_msa").alias("gloss_msa"))
    got = M.enrich(every.where("corpus = 'misbah' and search_key is not null"), "lane_root", donor, ["gloss_msa"], "donor")
    return got.groupBy("search_key").agg(F.count(F.lit(1)).alias("candidates"), F.count("filled_from").alias("filled"))


add(
    "range_join",
    lambda s, d: G.range_join(
        _records(s, d).select("corpus", "id", F.explode("numberscovered").alias("n")), "n",
        _records(s, d).where("number is not null and kitab.idx is not null").groupBy("corpus", F.col("kitab.idx").alias("part")).agg(F.min("number").alias("lo"), F.max("number").alias("hi")), "lo", "hi", ["corpus"],
    ).groupBy("corpus", "id").agg(F.min_by("part", F.struct("n", "lo", "part")).alias("part"), F.min("n").alias("n")),
    f"""WITH {REC}, g AS (SELECT corpus, kitab.idx AS part, min(number) lo, max(number) hi FROM rec WHERE number IS NOT NULL AND kitab.idx IS NOT NULL GROUP BY ALL), n AS (SELECT corpus, id, unnest(numberscovered) n FROM rec)
SELECT n.corpus, id, min_by(part, (n, lo, part)) AS part, min(n) AS n FROM n JOIN g ON g.corpus = n.corpus AND n BETWEEN lo AND hi GROUP BY n.corpus, id""",
)
add(
    "local_over_declared",
    lambda s, d: _whole(s, d).select("id", *[c.alias(n) for c, n in zip(G.preferred([("local", F.when(F.col("editionnumber").isNotNull(), F.format_string("https://audio.example/%04d.mp3", "editionnumber"))), ("declared", F.concat(F.lit("https://audio.example/d/"), F.lpad(F.col("displaynumber").cast("string"), 5, "0")))]), ("url", "basis"))]).where("url is not null"),
    f"""WITH {REC}, u AS (SELECT id, CASE WHEN editionnumber IS NOT NULL THEN 'https://audio.example/' || lpad(CAST(editionnumber AS VARCHAR), 4, '0') || '.mp3' END AS l, 'https://audio.example/d/' || lpad(CAST(displaynumber AS VARCHAR), 5, '0') AS e FROM rec)
SELECT id, coalesce(l, e) AS url, CASE WHEN l IS NOT NULL THEN 'local' WHEN e IS NOT NULL THEN 'declared' END AS basis FROM u WHERE coalesce(l, e) IS NOT NULL""",
)

# Roots and lemmas
_known_roots = lambda s, d: entries(s, d, "lane_root", "lane_entry_count").where("lane_root is not null and lane_entry_count >= 20").select("lane_root").distinct()
KN = "kn AS (SELECT DISTINCT lane_root FROM sur WHERE lane_root IS NOT NULL AND lane_entry_count >= 20)"
add(
    "majority_vote",
    lambda s, d: L.majority_vote(entries(s, d, "search_key", "root").select("search_key", X.root_key("root").alias("root")), "search_key", "root", _known_roots(s, d)),
    f"""WITH {SUR}, {KN}, n AS (SELECT search_key, {_RK('root')} AS root, count(*) n FROM sur WHERE root IS NOT NULL AND search_key IS NOT NULL GROUP BY ALL), b AS (SELECT search_key, max(n) votes, sum(n) c FROM n GROUP BY 1),
t AS (SELECT search_key, votes, c, count(*) tied, count(lane_root) tk, min(lane_root) ok, min(root) lo FROM n JOIN b USING (search_key) LEFT JOIN kn ON lane_root = root WHERE n = votes GROUP BY ALL),
z AS (SELECT *, CASE WHEN tied = 1 AND c = votes THEN 'unanimous' WHEN tied = 1 THEN 'majority' WHEN tk = 1 THEN 'known' ELSE 'unresolved' END AS basis FROM t)
SELECT search_key, CASE WHEN basis = 'known' THEN ok ELSE lo END AS winner, votes, CAST(c AS BIGINT) AS cast, basis FROM z""",
)
add(
    "analysis_support",
    lambda s, d: L.support(entries(s, d, "search_key", "root").select("search_key", X.root_key("root").alias("root")), "search_key", "root"),
    f"WITH {SUR}, n AS (SELECT search_key, {_RK('root')} AS root, count(*) support FROM sur WHERE root IS NOT NULL AND search_key IS NOT NULL GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY search_key ORDER BY support DESC, root) AS INTEGER) AS place FROM n",
)


def _bakeoff(s, d):
    """Two sources' roots against each other, and where they differ which of them a third one knows."""
    lemma = F.substring(X.root_key("lemma"), 1, 3)
    rows = entries(s, d, "root", "lemma").select(X.root_key("root").alias("a"), F.nullif(lemma, F.lit("")).alias("b"))
    known = lambda side: _known_roots(s, d).select(F.col("lane_root").alias(side), F.lit(True).alias(f"{side}_known"))
    rows = rows.join(known("a"), "a", "left").join(known("b"), "b", "left")
    outcome = F.when(F.col("a").isNull() & F.col("b").isNull(), "neither").when(F.col("a").isNull(), "second only").when(F.col("b").isNull(), "first only").when(F.col("a") == F.col("b"), "agree").otherwise("disagree")
    yes = lambda side: F.coalesce(f"{side}_known", F.lit(False))
    third = F.when(outcome == "disagree", F.when(yes("a") & yes("b"), "both").when(yes("a"), "first").when(yes("b"), "second").otherwise("none"))
    return rows.groupBy(outcome.alias("outcome"), third.alias("third")).agg(F.count(F.lit(1)).alias("n"))


add(
    "source_bakeoff",
    _bakeoff,
    f"""WITH {SUR}, {KN}, r AS (SELECT {_RK('root')} AS a, nullif(substr({_RK('lemma')}, 1, 3), '') AS b FROM sur), k AS (SELECT a, b, a IN (SELECT lane_root FROM kn) AS ak, b IN (SELECT lane_root FROM kn) AS bk,
CASE WHEN a IS NULL AND b IS NULL THEN 'neither' WHEN a IS NULL THEN 'second only' WHEN b IS NULL THEN 'first only' WHEN a = b THEN 'agree' ELSE 'disagree' END AS outcome FROM r)
SELECT outcome, CASE WHEN outcome = 'disagree' THEN CASE WHEN ak AND bk THEN 'both' WHEN ak THEN 'first' WHEN bk THEN 'second' ELSE 'none' END END AS third, count(*) AS n FROM k GROUP BY ALL""",
)
_STEM_WORDS = lambda s, d: entries(s, d, "search_key", "unvocalized", "gloss_msa").where("search_key is not null").groupBy("search_key").agg(F.min("unvocalized").alias("u"), F.min("gloss_msa").alias("g"))
add(
    "stem_recover",
    lambda s, d: L.stem_recover(
        _STEM_WORDS(s, d).select("search_key", F.when(F.col("g").contains(" + "), ~F.col("g").startswith("[")).alias("before"), F.lit(None).cast("boolean").alias("after"), F.substring(F.rtrim("u"), -1, 1).alias("final")), "search_key",
        entries(s, d, "search_key", "root", "freq").where("search_key is not null").groupBy(F.col("search_key").alias("stem"), "root").agg(F.max("freq").alias("freq")), PRO, ENC,
    ),
    f"""WITH {SUR}, w AS (SELECT search_key k, min(unvocalized) u, min(gloss_msa) g FROM sur WHERE search_key IS NOT NULL GROUP BY 1), a AS (SELECT * FROM (VALUES {', '.join(f"('{p}', '{e}')" for p in PRO for e in ENC if p or e)}) v(p, e)),
c AS (SELECT k, substr(k, length(p) + 1, length(k) - length(p) - length(e)) st FROM w JOIN a ON starts_with(k, p) AND ends_with(k, e) WHERE (g IS NULL OR NOT contains(g, ' + ') OR (NOT starts_with(g, '[')) = (p <> '')) AND NOT (e = 'ه' AND coalesce(right(rtrim(u), 1) = 'ة', false))),
l AS (SELECT search_key st, root, max(freq) f FROM sur WHERE search_key IS NOT NULL AND root IS NOT NULL GROUP BY ALL)
SELECT k AS search_key, min_by(st, (-length(st), -coalesce(f, 0), st, root)) AS stem, min_by(root, (-length(st), -coalesce(f, 0), st, root)) AS root FROM c JOIN l USING (st) WHERE length(st) >= 2 AND st <> k GROUP BY k""",
)
add(
    "source_precedence",
    lambda s, d: entries(s, d, "root", "lane_root", "lemma").select("match_id", X.merge_roots(F.when(F.col("lane_root").isNotNull(), F.array_compact(F.array("lane_root", F.nullif(F.substring(X.root_key("lemma"), 1, 3), F.lit(""))))), X.root_key("root"), F.array_compact(F.array(F.nullif(F.substring(X.root_key("lemma"), 1, 3), F.lit("")))), F.lit("voted")).alias("m")).select("match_id", "m.root", F.array_join("m.others", "|").alias("others"), "m.basis"),
    f"""WITH {SUR}, r AS (SELECT match_id, CASE WHEN lane_root IS NULL THEN [] WHEN nullif(substr({_RK('lemma')}, 1, 3), '') IS NULL THEN [lane_root] ELSE [lane_root, substr({_RK('lemma')}, 1, 3)] END AS fs, {_RK('root')} AS b, CASE WHEN nullif(substr({_RK('lemma')}, 1, 3), '') IS NULL THEN [] ELSE [substr({_RK('lemma')}, 1, 3)] END AS al FROM sur),
z AS (SELECT *, CASE WHEN len(fs) > 0 AND b IS NOT NULL THEN CASE WHEN list_contains(list_transform(fs, lambda x: {_RK('x')}), {_RK('b')}) THEN 'agree' ELSE 'first' END WHEN len(fs) > 0 THEN 'first-only' WHEN b IS NOT NULL THEN 'second-voted' END AS basis FROM r)
SELECT match_id, CASE basis WHEN 'agree' THEN b WHEN 'second-voted' THEN b WHEN 'first' THEN fs[1] WHEN 'first-only' THEN fs[1] END AS root,
array_to_string(CASE basis WHEN 'agree' THEN list_sort(list_distinct(list_filter(fs || al, lambda x: {_RK('x')} <> {_RK('b')}))) WHEN 'first' THEN list_sort(list_distinct(fs[2:] || [b] || al)) WHEN 'first-only' THEN fs[2:] WHEN 'second-voted' THEN al ELSE [] END, '|') AS others, basis FROM z""",
)
add(
    "root_display",
    lambda s, d: entries(s, d, "root", "lane_root", "lemma", "search_key", "morph_confidence").select(
        "match_id",
        *[c.alias(n) for c, n in zip(root_display([
            ("context", F.when((F.col("morph_confidence") == "high"), F.col("lane_root"))), ("agreed", F.when(X.root_key("root") == F.col("lane_root"), F.col("lane_root"))), ("curated", X.root_key("root")),
            ("analyser", F.col("lane_root")), ("recovered", F.nullif(F.substring(X.root_key("lemma"), 1, 3), F.lit(""))),
        ]), ("shown", "basis"))],
    ),
    f"""WITH {SUR}, k AS (SELECT match_id, CASE WHEN morph_confidence = 'high' THEN lane_root END a, CASE WHEN {_RK('root')} = lane_root THEN lane_root END b, nullif({_RK('root')}, '') c, lane_root e, nullif(substr({_RK('lemma')}, 1, 3), '') f FROM sur)
SELECT match_id, coalesce(a, b, c, e, f) AS shown, CASE WHEN a IS NOT NULL THEN 'context' WHEN b IS NOT NULL THEN 'agreed' WHEN c IS NOT NULL THEN 'curated' WHEN e IS NOT NULL THEN 'analyser' WHEN f IS NOT NULL THEN 'recovered' END AS basis FROM k""",
)

# Statistics of the bound texts
_BODY = "layer in ('matn', 'zawaid')"
_layered = lambda s, d: bound(s, d).join(_records(s, d).select(F.col("id").alias("record_id"), "layer"), "record_id", "left")
_share = lambda a, b: F.floor(F.col(a) * 1_000_000 / F.nullif(F.col(b), F.lit(0))).cast("bigint")


def _tally(s, d):
    per = _layered(s, d).groupBy("corpus", "tier").agg(F.count(F.lit(1)).alias("tokens"), F.count_if(F.expr(_BODY)).alias("body"))
    whole = per.groupBy("corpus").agg(F.sum("tokens").alias("all"), F.sum("body").alias("all_body"))
    return per.join(whole, "corpus").select("corpus", "tier", "tokens", "body", _share("tokens", "all").alias("share_ppm"), _share("body", "all_body").alias("body_ppm"))


add(
    "tier_tally",
    _tally,
    f"""WITH {BND}, {REC}, p AS (SELECT bnd.corpus, tier, count(*) AS tokens, count(*) FILTER (WHERE {_BODY}) AS body FROM bnd LEFT JOIN rec ON id = record_id GROUP BY ALL)
SELECT corpus, tier, tokens, body, CAST(floor(tokens * 1000000 / sum(tokens) OVER (PARTITION BY corpus)) AS BIGINT) AS share_ppm, CAST(floor(body * 1000000 / nullif(sum(body) OVER (PARTITION BY corpus), 0)) AS BIGINT) AS body_ppm FROM p""",
)
#: Shares in percent that a collection must reach; a collection that declares none is not gated.
GATES = [("misbah", 94), ("hadiqa", 90), ("safina", 99), ("manara", 60)]


def _gates(s, d):
    got = bound(s, d).groupBy("corpus").agg(F.count(F.lit(1)).alias("tokens"), F.count_if(F.col("tier") <= 2).alias("witnessed"))
    got = got.join(s.createDataFrame(GATES, "corpus string, gate int"), "corpus", "left")
    state = F.when(F.col("gate").isNull(), "NOT_GATED").when(F.col("witnessed") * 100 >= F.col("tokens") * F.col("gate"), "PASS").otherwise("FAIL")
    return got.select("corpus", "tokens", "witnessed", state.alias("state"))


add(
    "coverage_gate",
    _gates,
    f"WITH {BND}, ga(corpus, gate) AS (VALUES " + ", ".join(f"('{c}', {g})" for c, g in GATES) + "), g AS (SELECT corpus, count(*) tokens, count(*) FILTER (WHERE tier <= 2) witnessed FROM bnd GROUP BY 1) SELECT g.corpus, tokens, witnessed, CASE WHEN gate IS NULL THEN 'NOT_GATED' WHEN witnessed * 100 >= tokens * gate THEN 'PASS' ELSE 'FAIL' END AS state FROM g LEFT JOIN ga ON ga.corpus = g.corpus",
)
_KINDS = {"source": "binding = 'source'", "only": "binding = 'unique' AND confidence = 'high'", "only_uncertain": "binding = 'unique' AND confidence <> 'high'", "aligned": "binding = 'aligned'", "heuristic": "binding = 'heuristic'", "unbound": "binding = 'unbound'"}
add(
    "binding_shares",
    lambda s, d: bound(s, d).groupBy("corpus").agg(F.count(F.lit(1)).alias("tokens"), *[F.nullif(F.count_if(F.expr(e)), F.lit(0)).alias(n) for n, e in _KINDS.items()]).select("corpus", *[_share(n, "tokens").alias(n) for n in _KINDS]),
    f"WITH {BND} SELECT corpus, " + ", ".join(f"CAST(floor(nullif(count(*) FILTER (WHERE {e}), 0) * 1000000 / count(*)) AS BIGINT) AS {n}" for n, e in _KINDS.items()) + " FROM bnd GROUP BY corpus",
)
add(
    "drift_check",
    lambda s, d: M.drift(bound(s, d).where("match_id is not null").groupBy("match_id").agg(F.count_distinct("record_id").alias("doc_freq")), table(s, d, "surface").where("match_id is not null").groupBy("match_id").agg(F.max("doc_freq").alias("doc_freq")), "match_id", "doc_freq", F.greatest(F.lit(1.0), F.col("expected") * 0.05)).groupBy("state").agg(F.count(F.lit(1)).alias("terms")),
    f"""WITH {BND}, m AS (SELECT match_id, count(DISTINCT record_id) a FROM bnd WHERE match_id IS NOT NULL GROUP BY 1), e AS (SELECT * FROM (SELECT match_id, max(doc_freq) b FROM surface WHERE match_id IS NOT NULL GROUP BY 1) WHERE b IS NOT NULL)
SELECT CASE WHEN b IS NULL THEN 'unexpected' WHEN a IS NULL THEN 'missing' WHEN abs(a - b) <= greatest(1.0, b * 0.05) THEN 'ok' ELSE 'drift' END AS state, count(*) AS terms FROM m FULL JOIN e USING (match_id) GROUP BY 1""",
)
add(
    "weighted_estimate",
    lambda s, d: M.weighted_estimate(bound(s, d).groupBy("tier").agg(F.count_if(F.col("confidence") == "high").alias("right"), F.count_if(F.col("confidence").isin("high", "low")).alias("judged"), F.count(F.lit(1)).alias("population")).where("judged > 0"), "right", "judged", "population"),
    f"WITH {BND}, g AS (SELECT tier, count(*) FILTER (WHERE confidence = 'high') r, count(*) FILTER (WHERE confidence IN ('high', 'low')) j, count(*) p FROM bnd GROUP BY 1) SELECT CAST(floor(sum(r * p / j) * 1000000 / sum(p)) AS BIGINT) AS estimate_ppm FROM g WHERE j > 0",
)
add(
    "audit_sample",
    lambda s, d: M.hash_sample(_context(s, d), "tier", "token", 15, "audit|").select("tier", "token", "place", "raw", "context"),
    f"""WITH {BND}, c AS (SELECT tier, record_id || ':' || i AS token, raw, coalesce(string_agg(raw, ' ') OVER (PARTITION BY record_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), '') AS context FROM bnd)
SELECT tier, token, place, raw, context FROM (SELECT *, CAST(row_number() OVER (PARTITION BY tier ORDER BY md5('audit|' || token), token) AS INTEGER) AS place FROM c) WHERE place <= 15""",
)


def _context(s, d):
    """Every bound token with the words around it, read off the record's own array."""
    rows = latest_by(table(s, d, "bindings"), ["record_id"], "loaded_at", ["tokens"])
    rows = rows.select("record_id", F.array_sort(F.transform("tokens", lambda t: F.struct(t["i"].alias("i"), t["raw"].alias("raw"), t["tier"].alias("tier")))).alias("ts"))
    wide = F.transform("ts", lambda t, k: F.struct(t["i"].alias("i"), t["raw"].alias("raw"), t["tier"].alias("tier"), F.array_join(F.transform(F.slice("ts", F.greatest(k - 2, F.lit(1)), k + 4 - F.greatest(k - 2, F.lit(1)) + 1), lambda x: x["raw"]), " ").alias("context")))
    return rows.select("record_id", F.inline(wide)).select("tier", F.concat_ws(":", "record_id", F.col("i").cast("string")).alias("token"), "raw", "context")


add(
    "rebuild",
    lambda s, d: M.rebuild(
        table(s, d, "surface").where("match_id is not null and corpus is not null").groupBy("match_id").agg(F.min("corpus").alias("corpus"), F.min("freq").alias("freq")),
        entries(s, d, "corpus", "freq").where("corpus = 'hadiqa'"), "corpus", "match_id",
    ),
    f"""WITH {SUR}, b AS (SELECT match_id, corpus, freq FROM sur WHERE corpus = 'hadiqa'), p AS (SELECT match_id, min(corpus) AS corpus, min(freq) AS freq FROM surface WHERE match_id IS NOT NULL AND corpus IS NOT NULL GROUP BY 1)
SELECT * FROM p WHERE corpus <> 'hadiqa' AND match_id NOT IN (SELECT match_id FROM b) UNION ALL SELECT * FROM b""",
)
add(
    "lexicon_build",
    lambda s, d: _lexicon(s, d),
    f"""WITH {BND}, {SUR}, st AS (SELECT match_id, count(*) AS freq, count(DISTINCT record_id) AS doc_freq FROM bnd WHERE match_id IS NOT NULL GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY freq DESC, match_id) AS rank, CAST(floor(sum(freq) OVER (ORDER BY freq DESC, match_id) * 1000000 / sum(freq) OVER ()) AS BIGINT) AS cum_ppm FROM st)
SELECT r.match_id, r.freq, r.doc_freq, r.rank, cum_ppm, search_key, root, lemma, gloss_msa, CAST(NULL AS VARCHAR) AS analyst FROM r LEFT JOIN sur USING (match_id)""",
)


def _lexicon(s, d):
    """The texts' own lexicon: counted statistics with the fields that an older lexicon carries over, and those that it
    cannot know as nulls."""
    per = bound(s, d).where("match_id is not null").groupBy("match_id", "record_id").agg(F.count(F.lit(1)).alias("n"))
    stats = per.groupBy("match_id").agg(F.sum("n").alias("freq"), F.count(F.lit(1)).alias("doc_freq"))
    ranked = L.freq_rank(stats, "match_id").select("match_id", "freq", "doc_freq", "rank", "cum_ppm")
    return ranked.join(entries(s, d, "search_key", "root", "lemma", "gloss_msa"), "match_id", "left").withColumn("analyst", F.lit(None).cast("string"))


add(
    "shard_routing",
    lambda s, d: entries(s, d, "search_key", "corpus").where("search_key is not null").select("match_id", (X.fnv1a("search_key") % 64).alias("shared_shard"), F.concat_ws("/", F.coalesce("corpus", F.lit("-")), (X.fnv1a("match_id") % 16).cast("string")).alias("stats_shard")),
    f"WITH {SUR} SELECT match_id, {_FNV.format(c='search_key')} % 64 AS shared_shard, coalesce(corpus, '-') || '/' || CAST({_FNV.format(c='match_id')} % 16 AS VARCHAR) AS stats_shard FROM sur WHERE search_key IS NOT NULL",
)
_seqs = lambda s, d: _records(s, d).select(F.col("id").alias("record_id"), "seq")
add(
    "root_index",
    lambda s, d: L.inverted_index(bound(s, d).where("match_id is not null").join(_seqs(s, d), "record_id").join(entries(s, d, "root").select("match_id", X.root_key("root").alias("root")).where("root <> ''"), "match_id").select("corpus", F.col("root").alias("key"), "seq", "i")).select("corpus", F.col("key").alias("root"), "seq", F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"), "delta"),
    f"""WITH {BND}, {REC}, {SUR}, t AS (SELECT bnd.corpus, {_RK('root')} AS root, seq, i FROM bnd JOIN rec ON id = record_id JOIN sur USING (match_id) WHERE {_RK('root')} <> ''), g AS (SELECT corpus, root, seq, string_agg(i, ',' ORDER BY i) AS positions FROM t GROUP BY ALL)
SELECT corpus, root, seq, positions, seq - coalesce(lag(seq) OVER (PARTITION BY corpus, root ORDER BY seq), 0) AS delta FROM g""",
)
_front = lambda s, d: _records(s, d).where(F.col("layer").startswith("heading") | (F.col("layer") == "frontmatter")).select("corpus", "seq", F.when(F.col("layer") == "heading_kitab", 1).otherwise(2).alias("depth"), ((F.col("layer") == "frontmatter") | (F.col("seq") % 7 == 0)).alias("starts"))
add(
    "sticky_front",
    lambda s, d: S.sticky_front(_front(s, d), "corpus", "seq", "depth", "starts", depths=3).select("corpus", "seq", "front"),
    f"""WITH {REC}, h AS (SELECT corpus, seq, CASE WHEN layer = 'heading_kitab' THEN 1 ELSE 2 END AS depth, layer = 'frontmatter' OR seq % 7 = 0 AS starts FROM rec WHERE layer LIKE 'heading%' OR layer = 'frontmatter')
SELECT corpus, seq, starts OR (depth > 1 AND coalesce(last_value(CASE WHEN depth <= 1 THEN starts END IGNORE NULLS) OVER (PARTITION BY corpus ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false)) AS front FROM h""",
)


# A stream of deliveries
def _streamed(s, d):
    """Word counts from the records as a stream in one run of available micro-batches."""
    src = table(s, d, "records").select("id", "textraw", "loaded_at")
    inbox, out = scratch(s, "inbox"), scratch(s, "counts")
    src.repartition(4, "id").write.parquet(inbox)
    stream = s.readStream.schema(src.schema).option("maxFilesPerTrigger", 2).parquet(inbox)
    q = upsert.append_batches(upsert.token_stream(stream), out, f"{scratch(s, 'stream')}/{uuid.uuid4().hex}")
    q.awaitTermination()
    return upsert.totals(s.read.parquet(out))


add("stream_totals", _streamed, f"WITH {WRD} SELECT key AS word, count(*) AS freq, count(DISTINCT record_id) AS doc_freq FROM wrd GROUP BY key")
