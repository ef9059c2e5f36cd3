"""Nested records into related flat tables, by shared inlining of the schema graph.

The schema is read as a graph of types. A type gets a table of its own when it is a root, repeated (the
element of an array), shared (reached from more than one place) or recursive; every other struct is a
singleton descendant and is inlined into its owner's row as prefixed columns. Each child row carries its
own key, its parent's key and its 0-based position in the delivered list, null elements counted. A map is a list of
its entries, a type with key and value.

Keys are paths (`root key/field/position`), so they need no shuffle and come out alike in every run; a slash or a
percent sign in a root key is escaped. Descendants can carry columns of an ancestor (a natural key), so that a table
is read with its owner's key and without a join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.session import materialise


@dataclass
class Edge:
    """One field of a type: a scalar, a singleton struct or a list."""

    name: str
    kind: str  # scalar | struct | list | map
    to: str | None = None  # the type it leads to; None for scalars and lists of scalars
    dtype: T.DataType | None = None


@dataclass
class Graph:
    """Types by name with their edges, and how often each type is reached."""

    edges: dict[str, list[Edge]] = field(default_factory=dict)
    reached: dict[str, int] = field(default_factory=dict)
    repeated: set[str] = field(default_factory=set)
    roots: list[str] = field(default_factory=list)

    def recursive(self) -> set[str]:
        """Types that can reach themselves."""
        out = set()
        for start in self.edges:
            todo, seen = [e.to for e in self.edges[start] if e.to], set()
            while todo:
                t = todo.pop()
                if t == start:
                    out.add(start)
                    break
                if t not in seen:
                    seen.add(t)
                    todo += [e.to for e in self.edges.get(t, []) if e.to]
        return out

    def own_tables(self) -> set[str]:
        """Types that need a table: roots, repeated, shared and recursive ones; the rest is inlined."""
        shared = {t for t, n in self.reached.items() if n > 1}
        return {*self.roots} | self.repeated | shared | self.recursive()


def schema_graph(roots: dict[str, T.StructType]) -> Graph:
    """The graph of one or more root schemas. Structs that are equal under equal field names are one type,
    so an element delivered in two places is recognised as shared. A type's name is that of the field it was
    first met under."""
    g, known = Graph(), {}

    def visit(st: T.StructType, hint: str) -> str:
        key = st.jsonValue().__repr__()
        if key in known:
            return known[key]
        name, k = hint, 2
        while name in g.edges:
            name, k = f"{hint}_{k}", k + 1
        known[key] = name
        g.edges[name] = []
        for f in st.fields:
            dt = f.dataType
            if isinstance(dt, T.StructType):
                to = visit(dt, f.name)
                g.reached[to] = g.reached.get(to, 0) + 1
                g.edges[name].append(Edge(f.name, "struct", to, dt))
            elif isinstance(dt, T.ArrayType):
                to = None
                if isinstance(dt.elementType, T.StructType):
                    to = visit(dt.elementType, f.name)
                    g.reached[to] = g.reached.get(to, 0) + 1
                    g.repeated.add(to)
                g.edges[name].append(Edge(f.name, "list", to, dt))
            elif isinstance(dt, T.MapType):
                to = visit(T.StructType([T.StructField("key", dt.keyType), T.StructField("value", dt.valueType)]), f.name)
                g.reached[to] = g.reached.get(to, 0) + 1
                g.repeated.add(to)
                g.edges[name].append(Edge(f.name, "map", to, dt))
            else:
                g.edges[name].append(Edge(f.name, "scalar", None, dt))
        return name

    for name, st in roots.items():
        g.roots.append(visit(st, name))
    return g


def shred(df: DataFrame, key: str, graph: Graph, root: str, carry: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """The flat tables of df, whose row type is `root` of the graph and whose unique string key is `key`.

    Every table has `row_key`, `parent_key`, `parent` (the table the parent lies in), `pos` and `is_null`
    (a null element keeps its row and position) with the scalar and inlined columns; a list of scalars becomes
    a table with the column `value`. The root's `parent_key` and `pos` are null. Null and empty lists give
    no rows; an empty df gives empty tables. Columns of df outside the root type are ignored, so clashing
    names do no harm: the struct's own fields are taken from inside it. carry: scalar fields by type, which all
    tables below that type get as `type_field`.
    """
    own, carry = graph.own_tables(), carry or {}
    out: dict[str, DataFrame] = {}

    def flat(t: str, at: Column, prefix: str = "") -> list[Column]:
        cols = []
        for e in graph.edges[t]:
            if e.kind == "scalar":
                cols.append(at[e.name].alias(f"{prefix}{e.name}"))
            elif e.kind == "struct" and e.to not in own:
                cols += flat(e.to, at[e.name], f"{prefix}{e.name}_")
        return cols

    def lists(t: str, at: Column, prefix: str = "") -> list[tuple[str, Column, str | None, bool]]:
        """Lists and shared structs that leave this type's row, as arrays: name, array, type, is a list."""
        got = []
        for e in graph.edges[t]:
            if e.kind in ("list", "map"):
                got.append((f"{prefix}{e.name}", at[e.name] if e.kind == "list" else F.map_entries(at[e.name]), e.to, True))
            elif e.kind == "struct" and e.to in own:
                one = F.when(at[e.name].isNotNull(), F.array(at[e.name]))
                got.append((f"{prefix}{e.name}", one, e.to, False))
            elif e.kind == "struct":
                got += lists(e.to, at[e.name], f"{prefix}{e.name}_")
        return got

    def add(name: str, d: DataFrame) -> None:
        out[name] = out[name].unionByName(d, allowMissingColumns=True) if name in out else d

    def table(t: str, nodes: DataFrame, name: str, depth: int, above: list[str]) -> None:
        at = F.col("__node")
        keys = [F.col(c) for c in ("row_key", "parent_key", "parent", "pos", "is_null")]
        add(name, nodes.select(*keys, *above, *flat(t, at)))
        below = [*above, *[f"{t}_{c}" for c in carry.get(t, [])]]
        nodes = nodes.withColumns({f"{t}_{c}": at[c] for c in carry.get(t, [])}) if carry.get(t) else nodes
        if depth > 64:
            raise ValueError("a Spark schema nests no deeper than 64 types here; recursive data go through shred_tree")
        for path, arr, to, _ in lists(t, at):
            kids = nodes.select(F.col("row_key").alias("parent_key"), *below, F.posexplode(arr).alias("pos", "__item")).select(
                *below,
                F.concat_ws("/", "parent_key", F.lit(path), F.col("pos").cast("string")).alias("row_key"),
                "parent_key",
                F.lit(name).alias("parent"),
                "pos",
                F.col("__item").isNull().alias("is_null"),
                F.col("__item").alias("__node"),
            )
            if to is None:
                add(f"{name}_{path}", kids.select("row_key", "parent_key", "parent", "pos", "is_null", *below, F.col("__node").alias("value")))
            else:
                table(to, kids, to, depth + 1, below)

    fields = [e.name for e in graph.edges[root]]
    top = df.select(
        F.replace(F.replace(F.col(key).cast("string"), F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F")).alias("row_key"),
        F.lit(None).cast("string").alias("parent_key"),
        F.lit(None).cast("string").alias("parent"),
        F.lit(None).cast("int").alias("pos"),
        F.lit(False).alias("is_null"),
        F.struct(*fields).alias("__node"),
    )
    table(root, top, root, 0, [])
    return out


@dataclass(frozen=True)
class Drift:
    """How loosely shaped JSON is read: `text_field` of a struct takes a bare string in the struct's place
    ({"runs": "v"}); `key_field` of a list of scalars is where an object in a scalar's place has its text
    ({"forms": "orth"}). Both go by the list's field name."""

    text_field: dict[str, str] = field(default_factory=dict)
    key_field: dict[str, str] = field(default_factory=dict)


def conform(v: Column, dtype: T.DataType, drift: Drift = Drift(), name: str = "") -> Column:
    """A VARIANT read as dtype under drift: a single value in a list's place is a list of one, JSON null is
    null, missing keys are null, other keys are left out, numbers and booleans in a string's place keep their
    JSON spelling, an object or list without a place in dtype becomes its JSON text."""
    return F.transform(F.array(v), lambda x: _conform(x, dtype, drift, name))[0]


def _conform(v: Column, dtype: T.DataType, drift: Drift, name: str) -> Column:
    """As conform, v being a lambda variable: an expression in its place would be evaluated at every mention."""
    there = v.isNotNull() & ~F.is_variant_null(v)
    if isinstance(dtype, T.ArrayType):
        items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.when(there, F.array(v)))
        return F.transform(items, lambda x: _conform(x, dtype.elementType, drift, name))
    if isinstance(dtype, T.StructType):
        cols = []
        for f in dtype.fields:
            inner = conform(F.try_variant_get(v, f"$.{f.name}", "variant"), f.dataType, drift, f.name)
            if drift.text_field.get(name) == f.name:
                bare = F.try_variant_get(v, "$", "map<string,variant>").isNull()
                inner = F.when(bare, F.try_variant_get(v, "$", "string")).otherwise(inner)
            cols.append(inner.alias(f.name))
        return F.when(there, F.struct(*cols))
    plain = F.try_variant_get(v, "$", dtype.simpleString())
    if name in drift.key_field:
        is_map = F.try_variant_get(v, "$", "map<string,variant>").isNotNull()
        plain = F.when(is_map, F.try_variant_get(v, f"$.{drift.key_field[name]}", dtype.simpleString())).otherwise(plain)
    return F.when(there, plain)


def drift_report(df: DataFrame, body: str) -> DataFrame:
    """The observed schema of a JSON text column, merged over all rows (one row a schema): where shapes clash
    the type is VARIANT. Broken bodies count under `broken`. One partial aggregation; nothing per row leaves a task."""
    v = F.try_parse_json(F.col(body))
    return df.agg(
        F.schema_of_variant_agg(v).alias("merged_schema"),
        F.count(F.lit(1)).alias("bodies"),
        F.count_if(v.isNull()).alias("broken"),
    )


_STRAY = "array<struct<path: string, key: string, value: variant>>"


def _undeclared(v: Column, dtype: T.DataType, path: str = "") -> Column:
    """An array of struct<path, key, value> of the keys in v that dtype does not declare, at any depth."""
    none = F.array().cast(_STRAY)
    if isinstance(dtype, T.ArrayType):
        there = v.isNotNull() & ~F.is_variant_null(v)
        items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.when(there, F.array(v)))
        return F.coalesce(F.flatten(F.transform(items, lambda x: _undeclared(x, dtype.elementType, path))), none)
    if not isinstance(dtype, T.StructType):
        return none
    members = F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: ~k.isin(*dtype.names))
    found = [F.coalesce(F.transform(F.map_entries(members), lambda e: F.struct(F.lit(path).alias("path"), e["key"].alias("key"), e["value"].alias("value"))), none)]
    for f in dtype.fields:
        if isinstance(f.dataType, (T.ArrayType, T.StructType)):
            found.append(_undeclared(F.try_variant_get(v, f"$.{f.name}", "variant"), f.dataType, f"{path}.{f.name}".strip(".")))
    return F.concat(*found)


def observed_schema(df: DataFrame, body: str, declared: T.StructType) -> T.StructType:
    """declared with every key that the JSON texts of df have beside it, at its place in the nesting, in the order of the
    keys' names. A key's type is that of all its values; where they clash it is their JSON text.

    One pass and one partial aggregation by key: what reaches the driver is one row an undeclared key.
    """
    v = F.try_parse_json(F.col(body))
    rows = df.select(v.alias("v")).where("v is not null")
    stray = _undeclared(F.col("v"), declared)
    found = rows.select(F.inline(stray)).groupBy("path", "key").agg(F.schema_of_variant_agg("value").alias("shape")).orderBy("path", "key").collect()
    extra: dict[str, list[T.StructField]] = {}
    for r in found:
        extra.setdefault(r["path"], []).append(T.StructField(r["key"], shape_type(df, r["shape"])))

    def widened(dtype: T.DataType, path: tuple[str, ...]) -> T.DataType:
        if isinstance(dtype, T.ArrayType):
            return T.ArrayType(widened(dtype.elementType, path))
        if isinstance(dtype, T.StructType):
            return T.StructType([*[T.StructField(f.name, widened(f.dataType, (*path, f.name))) for f in dtype.fields], *extra.get(".".join(path), [])])
        return dtype

    return widened(declared, ())


def shape_type(df: DataFrame, shape: str) -> T.DataType:
    """The type of a variant's schema text, scalars and clashes as strings."""
    ddl = shape.replace("OBJECT<", "struct<").replace("ARRAY<", "array<")
    dtype = T._parse_datatype_string(ddl.replace("VARIANT", "string").replace("VOID", "string"))

    def plain(t: T.DataType) -> T.DataType:
        if isinstance(t, T.ArrayType):
            return T.ArrayType(plain(t.elementType))
        if isinstance(t, T.StructType):
            return T.StructType([T.StructField(f.name, plain(f.dataType)) for f in t.fields])
        return T.StringType()

    return plain(dtype)


def widen(c: Column, have: T.DataType, want: T.DataType) -> Column:
    """c of type `have` as `want`, which has the same fields and more: those are null. Nulls stay nulls."""
    if have == want:
        return c
    if isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType):
        return F.transform(c, lambda x: widen(x, have.elementType, want.elementType))
    if isinstance(want, T.StructType) and isinstance(have, T.StructType):
        mine = {f.name: f.dataType for f in have.fields}
        cols = [widen(c[f.name], mine[f.name], f.dataType).alias(f.name) if f.name in mine else F.lit(None).cast(f.dataType).alias(f.name) for f in want.fields]
        return F.when(c.isNotNull(), F.struct(*cols))
    return c.cast(want)


def json_nodes(df: DataFrame, key: str, body: str) -> DataFrame:
    """Every value of JSON texts as one recursive type in one table: key, row_key (the value's path, "$" the whole text),
    parent_key, name (a member's key, null of an element), pos (an element's place, null of a member), depth, kind
    (OBJECT, ARRAY or the scalar's type) and value (a scalar's text).

    One narrow pass a level until a level is empty; what is left to open is written between the levels, so none is
    parsed twice. JSON nests only so deep as it is long, so no limit is needed.
    """
    kid = df.select(F.col(key), F.lit("$").alias("row_key"), F.lit(None).cast("string").alias("parent_key"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("pos"), F.try_parse_json(F.col(body)).alias("v"))
    kid = kid.where("v is not null")
    out, depth = None, 0
    while True:
        level = materialise(kid, "json-level")
        kind = F.regexp_extract(F.schema_of_variant("v"), r"^(\w+)", 1)
        flat = level.select(key, "row_key", "parent_key", "name", "pos", F.lit(depth).alias("depth"), kind.alias("kind"), F.when(~kind.isin("OBJECT", "ARRAY"), F.try_variant_get("v", "$", "string")).alias("value"))
        if depth and level.isEmpty():
            return out
        out = flat if out is None else out.unionByName(flat)
        members = level.select(key, F.col("row_key").alias("parent_key"), F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("name", "v"))
        members = members.select(key, F.concat("parent_key", F.lit("."), "name").alias("row_key"), "parent_key", "name", F.lit(None).cast("int").alias("pos"), "v")
        items = level.select(key, F.col("row_key").alias("parent_key"), F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("pos", "v"))
        items = items.select(key, F.concat("parent_key", F.lit("["), F.col("pos").cast("string"), F.lit("]")).alias("row_key"), "parent_key", F.lit(None).cast("string").alias("name"), "pos", "v")
        kid, depth = members.unionByName(items), depth + 1


def shred_tree(df: DataFrame, key: str, node: str, child: str, scalars: list[str]) -> DataFrame:
    """A recursive JSON type (VARIANT column `node`, children under the key `child`) as one table with
    `row_key`, `parent_key`, `pos`, `depth` and the named scalar fields as strings.

    One narrow pass a level, until a level is empty; each level is written, so none is read off the source again.
    """
    kids = df.select(
        F.col(key).cast("string").alias("row_key"), F.lit(None).cast("string").alias("parent_key"), F.lit(None).cast("int").alias("pos"), F.col(node).alias("__v")
    )
    out, depth = None, 0
    while True:
        level = materialise(kids, "tree-level")
        if depth and level.isEmpty():
            return out
        flat = level.select(
            "row_key", "parent_key", "pos", F.lit(depth).alias("depth"), *[F.try_variant_get("__v", f"$.{s}", "string").alias(s) for s in scalars]
        )
        out = flat if out is None else out.unionByName(flat)
        below = conform(F.try_variant_get("__v", f"$.{child}", "variant"), T.ArrayType(T.VariantType()), name=child)
        kids = level.select(F.col("row_key").alias("parent_key"), F.posexplode(below).alias("pos", "__v")).select(
            F.concat_ws("/", "parent_key", F.lit(child), F.col("pos").cast("string")).alias("row_key"), "parent_key", "pos", "__v"
        )
        depth += 1
