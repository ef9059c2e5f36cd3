"""Ranges, carried columns, rebuilds, root sources, skewed keys: brute force and odd inputs."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wordloom.functions import text as X
from wordloom.operators import lexicon as L
from wordloom.operators import merge as M
from wordloom.operators import ranges as G
from wordloom.operators import search as Q
from wordloom.operators import segment as S
from wordloom.operators import skew


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_range_join_brute(spark, width):
    rng = random.Random(1)
    pts = [(rng.choice("ab"), rng.choice([None, *range(-50, 300)])) for _ in range(200)]
    rgs = [(rng.choice("ab"), lo, rng.choice([None, lo - 3, lo, lo + 40]), f"g{i}") for i, lo in enumerate(rng.choices(range(-60, 280), k=30))]
    p, r = spark.createDataFrame(pts, "k string, n int"), spark.createDataFrame(rgs, "k string, lo int, hi int, name string")
    want = sorted(((k, n, lo, hi, g) for k, n in pts for k2, lo, hi, g in rgs if k == k2 and n is not None and hi is not None and lo <= n <= hi), key=str)
    assert rows(G.range_join(p, "n", r, "lo", "hi", ["k"], width)) == want
    assert G.range_join(p.limit(0), "n", r, "lo", "hi", ["k"]).count() == 0


def test_heavy_keys_are_exact(spark):
    rng = random.Random(2)
    keys = [rng.choice([1, 1, 1, 65537, 131073, None, *range(100)]) for _ in range(3000)]
    n = Counter(k for k in keys if k is not None)
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    want = sorted((k, c) for k, c in n.items() if c > 40)
    assert sorted((r["k"], r["c"]) for r in skew.heavy_keys(df, "k", 40).collect()) == want
    for limit in (2, 500_000):
        got = skew.tag_heavy(df, "k", 40, limit)
        assert Counter((r["k"], r["c"]) for r in got.collect()) == Counter((k, n[k] if k is not None and n[k] > 40 else None) for k in keys)
    assert skew.tag_heavy(df.limit(0), "k", 40).count() == 0


def test_whitelists(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "id int, name string, old double")
    assert M.carry(df, ["id", "name"], ["old", "gone"]).columns == ["id", "name"]
    for carried, refused in ((["id"], ["old"]), (["id", "old"], ["name", "old"]), (["id", "name", "more"], ["old"])):
        with pytest.raises(ValueError):
            M.carry(df, carried, refused)


def test_rebuild_is_idempotent(spark):
    old = spark.createDataFrame([("a", "x", 1), ("b", "x", 2), ("c", "y", 3), ("d", "y", 4), ("e", None, 5)], "k string, corpus string, n int")
    new = spark.createDataFrame([("a", "x", 9), ("c", "x", 8)], "k string, corpus string, n int")
    want = [("a", "x", 9), ("c", "x", 8), ("d", "y", 4), ("e", None, 5)]
    once = M.rebuild(old, new, "corpus", "k")
    assert rows(once) == want and rows(M.rebuild(once, new, "corpus", "k")) == want


def test_merge_roots(spark):
    one = lambda *a: spark.createDataFrame([a], "f array<string>, s string, o array<string>, b string").select(X.merge_roots(F.col("f"), F.col("s"), F.col("o"), F.col("b")).alias("m")).select("m.*").first()
    assert tuple(one(["كتب", "كتم"], "كتب", ["قلم"], "v")) == ("كتب", ["قلم", "كتم"], "agree")
    assert tuple(one(["أكل"], "اكل", [], "v")) == ("اكل", [], "agree")
    assert tuple(one(["كتم", "قتل"], "كتب", ["قلم"], "v")) == ("كتم", ["قتل", "قلم", "كتب"], "first")
    assert tuple(one(["كتم", "قتل"], None, None, None)) == ("كتم", ["قتل"], "first-only")
    assert tuple(one(None, "كتب", ["قلم"], "v")) == ("كتب", ["قلم"], "second-v")
    assert tuple(one([], None, None, None)) == (None, [], None)


def test_majority_and_support(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "x"), ("b", "y"), ("c", "z"), ("d", "p"), ("d", "q"), ("e", None), (None, "x")], "k string, v string")
    known = spark.createDataFrame([("y",), ("r",)], "v string")
    assert [tuple(r) for r in rows(L.majority_vote(df, "k", "v", known))] == [("a", "y", 1, 2, "known"), ("b", "x", 2, 3, "majority"), ("c", "z", 1, 1, "unanimous"), ("d", "p", 1, 2, "unresolved")]
    assert rows(L.support(df.where("k = 'b'"), "k", "v")) == [("b", "x", 2, 1), ("b", "y", 1, 2)]


def test_drift_and_estimate(spark):
    a, b = spark.createDataFrame([("p", 10), ("q", 5), ("r", 1)], "k string, n int"), spark.createDataFrame([("p", 11), ("q", 9), ("s", 4), ("t", None)], "k string, n int")
    assert {r["k"]: r["state"] for r in M.drift(a, b, "k", "n", 1).collect()} == {"p": "ok", "q": "drift", "r": "unexpected", "s": "missing"}
    s = spark.createDataFrame([(1, 2, 100), (3, 3, 300)], "r int, j int, p int")
    assert M.weighted_estimate(s, "r", "j", "p").first()[0] == 875_000
    assert M.weighted_estimate(s.unionAll(spark.createDataFrame([(0, 0, 5)], s.schema)), "r", "j", "p").first()[0] is None


def test_stem_recovery_is_guided(spark):
    lex = spark.createDataFrame([("كتاب", "كتب", 5, ["book"]), ("جن", "جنن", 5, ["jinn"]), ("تاب", "توب", 9, ["repent"])], "stem string, root string, freq long, senses array<string>")
    words = spark.createDataFrame([("كتاب", False, None, "ب", ["book"]), ("وكتاب", True, None, "ب", ["book"]), ("جنه", None, None, "ة", ["jinn"]), ("جنه2", None, None, "ه", ["jinn"])], "k string, before boolean, after boolean, final string, senses array<string>")
    words = words.withColumn("k", F.regexp_replace("k", "2", ""))
    assert rows(L.stem_recover(words, "k", lex, ["", "و", "ك"], ["", "ه"])) == [("جنه", "جن", "جنن"), ("وكتاب", "كتاب", "كتب")]
    assert rows(L.stem_recover(words.where("final = 'ة'"), "k", lex, ["", "و"], ["", "ه"])) == []


def test_sticky_front_brute(spark):
    rng = random.Random(3)
    data = [(k, i, rng.choice([1, 2, 3, 4]), rng.random() < 0.3) for k in "ab" for i in range(60)]
    want = []
    for k in "ab":
        since = None
        for kk, i, d, s in data:
            if kk == k:
                inside = since is not None and d > since
                if not inside:
                    since = d if s else None
                want.append((k, i, inside or s))
    got = S.sticky_front(spark.createDataFrame(data, "k string, o int, d int, s boolean"), "k", "o", "d", "s")
    assert rows(got.select("k", "o", "front")) == sorted(want, key=str)


def test_quoted_words(spark):
    df = spark.createDataFrame([(1, "قال « هذا (من) بعد » ثم ) في { كل"), (2, ""), (3, None)], "k int, t string")
    assert [(r["word"], r["inside"]) for r in Q.quoted_words(df, "k", "t").orderBy("i").collect()] == [("قال", False), ("هذا", True), ("من", True), ("بعد", True), ("ثم", False), ("في", False), ("كل", True)]


def test_shred_maps_escapes_and_carries(spark):
    from wordloom.operators.shred import schema_graph, shred

    df = spark.createDataFrame([("a/b%", {"x": 1, "y": None}, [("p", {"k": ("z",)})]), ("c", None, None)], "id string, m map<string,int>, l array<struct<n: string, q: map<string,struct<w: string>>>>")
    t = shred(df, "id", schema_graph({"top": df.schema}), "top", {"top": ["id"]})
    assert rows(t["m"].select("top_id", "row_key", "pos", "key", "value")) == [("a/b%", "a%2Fb%25/m/0", 0, "x", 1), ("a/b%", "a%2Fb%25/m/1", 1, "y", None)]
    assert rows(t["q"].select("top_id", "parent_key", "key", "value_w")) == [("a/b%", "a%2Fb%25/l/0", "k", "z")]


def test_observed_schema_and_nodes(spark):
    from pyspark.sql import types as T

    from wordloom.operators.shred import json_nodes, observed_schema, widen

    declared = T.StructType([T.StructField("a", T.StringType()), T.StructField("l", T.ArrayType(T.StructType([T.StructField("n", T.StringType())])))])
    bodies = ['{"a": 1, "l": {"n": "x", "more": 2}}', '{"l": [{"n": "y", "more": "z"}, null, {"deep": {"u": [true]}}], "top": null}', "{broken", None, "3"]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "id int, b string")
    got = observed_schema(df, "b", declared)
    assert got.names == ["a", "l", "top"] and got["l"].dataType.elementType.names == ["n", "deep", "more"]
    assert got["l"].dataType.elementType["deep"].dataType.simpleString() == "struct<u:array<string>>" and observed_schema(df.limit(0), "b", declared) == declared
    one = spark.createDataFrame([("q", [("n",), None]), ("r", None)], declared)
    wide = one.select(widen(F.struct("a", "l"), declared, got).alias("s")).select("s.*")
    assert wide.schema["l"].dataType == got["l"].dataType and [len(r["l"]) if r["l"] else None for r in wide.orderBy("a").collect()] == [2, None]
    nodes = {(r["id"], r["row_key"]): (r["kind"], r["value"], r["depth"]) for r in json_nodes(df, "id", "b").collect()}
    assert nodes[0, "$.l.more"] == ("BIGINT", "2", 2) and nodes[1, "$.l[2].deep.u[0]"] == ("BOOLEAN", "true", 5) and nodes[4, "$"][0] == "BIGINT" and (2, "$") not in nodes
    assert json_nodes(df.limit(0), "id", "b").count() == 0
