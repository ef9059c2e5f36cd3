"""Problem 2: dictionary entries, delivered as a nested table and as drifting JSON bodies, as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.operators.shred import Drift, Graph, conform, drift_report, json_nodes, observed_schema, schema_graph, shred, widen
from wordloom.session import latest_by, materialise, table

DRIFT = Drift(text_field={"runs": "v"}, key_field={"forms": "orth"})


def _types(spark: SparkSession, sf_dir: str, raw: DataFrame) -> tuple[T.StructType, T.StructType]:
    """The types of an entry and of a body as the data have them: the nested table's own columns, and every key that
    the bodies add, wherever it stands."""
    own = T.StructType([f for f in table(spark, sf_dir, "entries").schema.fields if f.name != "loaded_at"])
    declared = T.StructType([T.StructField("root", T.StringType()), T.StructField("page", T.StringType()), T.StructField("entries", T.ArrayType(own))])
    body = observed_schema(raw, "body", declared)
    return body["entries"].dataType.elementType, body


def entry_tables(spark: SparkSession, sf_dir: str) -> tuple[Graph, dict[str, DataFrame]]:
    """The schema graph and the flat tables of both deliveries: entries is shared by the two roots, so its rows from the
    nested table (parent_key null) and from the bodies (parent_key the body's) lie in one table. What is below an
    entry carries its nodeid.

    Of a nodeid or raw_id only its latest delivery counts; a body that is no valid JSON gives nothing. Both
    are written once after parsing: the tables read them, each only its own columns.
    """
    raw = materialise(latest_by(table(spark, sf_dir, "entries_raw"), ["raw_id"], "loaded_at", ["body"]), "p2-raw")
    entry, body = _types(spark, sf_dir, raw)
    graph = schema_graph({"entries": entry, "bodies": body})
    flat = table(spark, sf_dir, "entries").schema
    nested = latest_by(table(spark, sf_dir, "entries"), ["nodeid"], "loaded_at", [f.name for f in flat.fields if f.name != "loaded_at"])
    nested = nested.select(F.concat(F.lit("entries:"), "nodeid").alias("row_key"), *[widen(F.col(f.name), flat[f.name].dataType, f.dataType).alias(f.name) if f.name in flat.names else F.lit(None).cast(f.dataType).alias(f.name) for f in entry.fields])
    nested = materialise(nested, "p2-entries")
    typed = raw.select("raw_id", conform(F.try_parse_json("body"), body, DRIFT).alias("b")).where(F.col("b").isNotNull())
    bodies = materialise(typed.select(F.concat(F.lit("bodies:"), F.col("raw_id").cast("string")).alias("row_key"), "b.*"), "p2-bodies")
    carry = {"entries": ["nodeid"]}
    out = shred(bodies, "row_key", graph, "bodies", carry)
    for name, d in shred(nested, "row_key", graph, "entries", carry).items():
        out[name] = out[name].unionByName(d, allowMissingColumns=True) if name in out else d
    return graph, out


BLANK = r"(?U)^\s*$"


def _sense_no() -> F.Column:
    return F.regexp_extract("parent_key", r"/senses/(\d+)$", 1).cast("int")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every form, sense and run by its entry's nodeid and 0-based positions; null elements, blank forms and
    runs with a blank `v` keep their position and are no cases. The tables carry the nodeid, so nothing is joined."""
    _, t = entry_tables(spark, sf_dir)
    row = lambda d, kind, sense, item: d.where("entries_nodeid is not null").select(F.col("entries_nodeid").alias("nodeid"), F.lit(kind).alias("kind"), sense.alias("sense_no"), item.alias("item_no"))
    told = lambda c: F.col(c).isNotNull() & ~F.col(c).rlike(BLANK)
    forms = row(t["entries_forms"].where(told("value")), "form", F.lit(-1), F.col("pos"))
    senses = row(t["senses"].where("not is_null"), "sense", F.col("pos"), F.lit(-1))
    runs = row(t["runs"].where(~F.col("is_null") & told("v")), "run", _sense_no(), F.col("pos"))
    return forms.unionByName(senses).unionByName(runs)


def p2_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All flat tables on top of each other: table, row_key, parent_key, parent, pos and the scalars as a map."""
    parts = []
    for name, d in sorted(entry_tables(spark, sf_dir)[1].items()):
        own = [c for c in d.columns if c not in ("row_key", "parent_key", "parent", "pos", "is_null")]
        pairs = [x for c in own for x in (F.lit(c), F.col(c).cast("string"))]
        values = F.to_json(F.create_map(*pairs)) if pairs else F.lit("{}")
        parts.append(d.select(F.lit(name).alias("table_name"), "row_key", "parent_key", "parent", "pos", values.alias("fields")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def p2_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of entries: its key and its parent's, the place in a body, root, headword, page and number."""
    d = entry_tables(spark, sf_dir)[1]["entries"].where("not is_null")
    return d.select("row_key", "parent_key", "pos", "nodeid", "root", "headword", F.col("page").cast("string").alias("page"), F.col("nodenum").cast("string").alias("nodenum"))


def p2_senses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of senses, by their entry's nodeid."""
    return entry_tables(spark, sf_dir)[1]["senses"].select(F.col("entries_nodeid").alias("nodeid"), "parent_key", "pos", "is_null", "label", "level")


def p2_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of runs, by their entry's nodeid and their sense's place."""
    d = entry_tables(spark, sf_dir)[1]["runs"]
    return d.select(F.col("entries_nodeid").alias("nodeid"), _sense_no().alias("sense_no"), "pos", "is_null", "t", "v")


def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of forms, by their entry's nodeid."""
    return entry_tables(spark, sf_dir)[1]["entries_forms"].select(F.col("entries_nodeid").alias("nodeid"), "pos", "value")


def p2_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the bodies' added keys hold, by the entry's nodeid: the columns and lists that the declared schema lacks."""
    graph, t = entry_tables(spark, sf_dir)
    declared = {"row_key", "parent_key", "parent", "pos", "is_null", *table(spark, sf_dir, "entries").columns}
    extra = [c for c in t["entries"].columns if c not in declared]
    parts = [t["entries"].where(F.col(c).isNotNull()).select("nodeid", F.lit(c).alias("name"), F.lit(-1).alias("pos"), F.col(c).cast("string").alias("value")) for c in extra]
    for name, d in sorted(t.items()):
        if name.startswith("entries_") and name not in ("entries_forms", "entries_itypes"):
            parts.append(d.select(F.col("entries_nodeid").alias("nodeid"), F.lit(name.removeprefix("entries_")).alias("name"), "pos", F.col("value").cast("string").alias("value")))
    if not parts:
        return t["entries"].limit(0).select("nodeid", F.lit("").alias("name"), F.lit(-1).alias("pos"), F.lit("").alias("value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def p2_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of every body as one recursive type: what a schema of whatever shape would be built from."""
    raw = latest_by(table(spark, sf_dir, "entries_raw"), ["raw_id"], "loaded_at", ["body"])
    return json_nodes(raw, "raw_id", "body").select("raw_id", "row_key", "depth", F.when(F.col("kind").isin("OBJECT", "ARRAY"), F.col("kind")).otherwise("SCALAR").alias("kind"), "value")


def p2_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema the bodies really have."""
    return drift_report(table(spark, sf_dir, "entries_raw"), "body")


QUERIES = {"p2_found": p2_found, "p2_tables": p2_tables, "p2_entries": p2_entries, "p2_senses": p2_senses, "p2_runs": p2_runs, "p2_forms": p2_forms, "p2_added": p2_added, "p2_tree": p2_tree, "p2_drift": p2_drift}

_BASE = r"""
WITH e AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY nodeid ORDER BY loaded_at DESC NULLS LAST) rn FROM entries WHERE nodeid IS NOT NULL) WHERE rn = 1),
f AS (SELECT nodeid, unnest(forms) v, generate_subscripts(forms, 1) - 1 i FROM e),
s AS (SELECT nodeid, unnest(senses) s, generate_subscripts(senses, 1) - 1 i FROM e),
r AS (SELECT nodeid, i, unnest(s.runs) r, generate_subscripts(s.runs, 1) - 1 j FROM s),
b AS (SELECT raw_id, body FROM (SELECT *, row_number() OVER (PARTITION BY raw_id ORDER BY loaded_at DESC NULLS LAST) rn FROM entries_raw WHERE raw_id IS NOT NULL) WHERE rn = 1),
bj AS (SELECT raw_id, CASE WHEN json_valid(body) THEN body::JSON END j FROM b),
be0 AS (SELECT raw_id, j -> '$.entries' x FROM bj WHERE j IS NOT NULL),
be1 AS (SELECT raw_id, CASE WHEN json_type(x) = 'ARRAY' THEN json_extract(x, '$[*]') WHEN json_type(x) = 'NULL' OR x IS NULL THEN [] ELSE [x] END l FROM be0),
be AS (SELECT raw_id, unnest(l) e, generate_subscripts(l, 1) - 1 p FROM be1),
bn AS (SELECT raw_id, p, e, e ->> '$.nodeid' nodeid, e -> '$.forms' fs, e -> '$.senses' ss FROM be WHERE json_type(e) = 'OBJECT'),
bf0 AS (SELECT nodeid, CASE WHEN json_type(fs) = 'ARRAY' THEN json_extract(fs, '$[*]') WHEN fs IS NULL OR json_type(fs) = 'NULL' THEN [] ELSE [fs] END l FROM bn),
bf AS (SELECT nodeid, unnest(l) v, generate_subscripts(l, 1) - 1 i FROM bf0),
bs0 AS (SELECT raw_id, p, nodeid, CASE WHEN json_type(ss) = 'ARRAY' THEN json_extract(ss, '$[*]') WHEN ss IS NULL OR json_type(ss) = 'NULL' THEN [] ELSE [ss] END l FROM bn),
bs AS (SELECT raw_id, p, nodeid, unnest(l) s, generate_subscripts(l, 1) - 1 i FROM bs0),
br0 AS (SELECT nodeid, i, s -> '$.runs' rs FROM bs WHERE json_type(s) = 'OBJECT'),
br1 AS (SELECT nodeid, i, CASE WHEN json_type(rs) = 'ARRAY' THEN json_extract(rs, '$[*]') WHEN rs IS NULL OR json_type(rs) = 'NULL' THEN [] ELSE [rs] END l FROM br0),
br AS (SELECT nodeid, i, unnest(l) r, generate_subscripts(l, 1) - 1 j FROM br1)
"""

P2_FOUND_SQL = _BASE + r""",
u AS (
SELECT nodeid, 'form' kind, -1 sense_no, i item_no, v FROM f
UNION ALL SELECT nodeid, 'sense', i, -1, CASE WHEN s IS NULL THEN NULL ELSE 'x' END FROM s
UNION ALL SELECT nodeid, 'run', i, j, r.v FROM r
UNION ALL SELECT nodeid, 'form', -1, i, CASE WHEN json_type(v) = 'OBJECT' THEN v ->> '$.orth' ELSE v ->> '$' END FROM bf
UNION ALL SELECT nodeid, 'sense', i, -1, CASE WHEN json_type(s) = 'NULL' THEN NULL ELSE 'x' END FROM bs
UNION ALL SELECT nodeid, 'run', i, j, CASE WHEN json_type(r) = 'OBJECT' THEN r ->> '$.v' ELSE r ->> '$' END FROM br)
SELECT nodeid, kind, CAST(sense_no AS INTEGER) AS sense_no, CAST(item_no AS INTEGER) AS item_no FROM u
WHERE nodeid IS NOT NULL AND v IS NOT NULL AND trim(v) <> ''
"""

_TXT = "CASE json_type({0}) WHEN 'NULL' THEN NULL ELSE {0} ->> '$' END"

ORACLE = {
    "p2_found": P2_FOUND_SQL,
    "p2_entries": _BASE + """SELECT 'entries:' || nodeid AS row_key, CAST(NULL AS VARCHAR) AS parent_key, CAST(NULL AS INTEGER) AS pos, nodeid, root, headword, CAST(page AS VARCHAR) AS page, CAST(nodenum AS VARCHAR) AS nodenum FROM e
UNION ALL SELECT 'bodies:' || raw_id || '/entries/' || p, 'bodies:' || raw_id, p, nodeid, e ->> '$.root', e ->> '$.headword', e ->> '$.page', e ->> '$.nodenum' FROM bn""",
    "p2_senses": _BASE + """SELECT nodeid, 'entries:' || nodeid AS parent_key, CAST(i AS INTEGER) AS pos, s IS NULL AS is_null, s.label AS label, s.level AS level FROM s
UNION ALL SELECT nodeid, 'bodies:' || raw_id || '/entries/' || p, i, json_type(s) = 'NULL', s ->> '$.label', s ->> '$.level' FROM bs""",
    "p2_runs": _BASE + f"""SELECT nodeid, CAST(i AS INTEGER) AS sense_no, CAST(j AS INTEGER) AS pos, r IS NULL AS is_null, r.t AS t, r.v AS v FROM r
UNION ALL SELECT nodeid, i, j, json_type(r) = 'NULL', CASE WHEN json_type(r) = 'OBJECT' THEN r ->> '$.t' END, CASE WHEN json_type(r) = 'OBJECT' THEN r ->> '$.v' ELSE {_TXT.format('r')} END FROM br""",
    "p2_forms": _BASE + f"""SELECT nodeid, CAST(i AS INTEGER) AS pos, v AS value FROM f UNION ALL SELECT nodeid, i, CASE WHEN json_type(v) = 'OBJECT' THEN v ->> '$.orth' ELSE {_TXT.format('v')} END FROM bf""",
    "p2_tree": _BASE + """SELECT raw_id, t.fullkey AS row_key, CAST(len(regexp_extract_all(t.fullkey, '[.\\[]')) AS INTEGER) AS depth, CASE WHEN t.type IN ('OBJECT', 'ARRAY') THEN t.type ELSE 'SCALAR' END AS kind, CASE WHEN t.type NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN t.value ->> '$' END AS value FROM bj, json_tree(bj.j) t WHERE j IS NOT NULL""",
}
