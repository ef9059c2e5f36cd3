"""Analysis, markup, front matter, binder extras and configuration."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom import config
from wordloom.functions import text as X
from wordloom.operators import analyse as N
from wordloom.operators import binder as B
from wordloom.operators import segment as S
from wordloom.profiles import ARABIC


@pytest.mark.parametrize(
    "form, lemma, ok",
    [("وَكَتَبَ", "كَتَبَ", True), ("كَتَبَ", "كُتِبَ", False), ("كَتَبَتْ", "كَتَبَ", True), ("كتب", "كُتِبَ", True), ("كَتَّبَ", "كَتَبَ", False), ("كتاب", "قلم", False), ("كَتَبٌ", "كَتَبَ", True), (None, "قلم", True)],
)
def test_compatible(spark, form, lemma, ok):
    df = spark.createDataFrame([(form, lemma)], "f string, l string")
    assert df.select(N.compatible("f", "l")).first()[0] is ok


@pytest.mark.parametrize("root, lemma, got", [("ك#ن", "تَكَوَّن", "كون"), ("ك#ن", "كان", None), ("كتب", None, "كتب"), ("#تب", "كتاب", None), ("ز#د", "زيد", "زيد"), (None, "x", None), ("م#", "مي", "مي"), ("#كل", "آكَل", "ءكل"), ("#ت#", "أَتَى", "ءتي"), ("##ب", "وب", "ووب"), ("ك##", "كوي", None), ("ك#ن", None, None)])
def test_recover_masked(spark, root, lemma, got):
    df = spark.createDataFrame([(root, lemma)], "r string, l string")
    assert df.select(N.recover_masked("r", "l")).first()[0] == got


def test_markup():
    xml = '<entry key="k">one <hi>two</hi>  three<form><orth>f</orth></form> &x <sense type="A" n="1"/>four <ref target="n1"/><pb/> five<sense n="2"/> </entry>'
    got = N.read_markup(xml)
    assert [(s["label"], s["level"]) for s in got] == [(None, "primary"), ("A1", "major")]
    assert [(r["t"], r["v"].strip()) for r in got[0]["runs"]] == [("t", "one"), ("i", "two"), ("t", "three &x")]
    assert [(r["t"], r["v"].strip()) for r in got[1]["runs"]] == [("t", "four"), ("ref", "n1"), ("t", "five")]
    assert N.read_markup("<broken") is None and N.read_markup(None) is None and N.read_markup("") is None and N.read_markup("<e/>") == []


def test_analyser_plug_in(spark):
    df = spark.createDataFrame([("ab",), ("ab",), (None,), ("c",)], "form string")
    schema = T.StructType([T.StructField("n", T.IntegerType())])
    got = N.analyse_forms(df, "form", lambda: lambda forms: [{"n": len(f)} if f != "c" else None for f in forms], schema)
    assert sorted((r["form"], r["analysis"] and r["analysis"]["n"]) for r in got.collect()) == [("ab", 2), ("c", None)]


def test_sticky_front(spark):
    rows = [(1, 0, 1, True), (1, 1, 2, False), (1, 2, 2, True), (1, 3, 1, False), (1, 4, 2, False), (2, 0, 2, False)]
    df = spark.createDataFrame(rows, "doc long, o int, depth int, starts boolean")
    got = S.sticky_front(df, "doc", "o", "depth", "starts").orderBy("doc", "o")
    assert [r["front"] for r in got.collect()] == [True, True, True, False, False, False]


def test_close_paragraphs(spark):
    df = spark.createDataFrame([(1, "intro\nT a\nunder\nS b\nbody\nmore\n1 - x\ny\n[1] n\nafter"), (2, ""), (3, None)], "doc long, text string")
    got = S.close_paragraphs(df, "doc", "text", {"top": "^T ", "sub": "^S ", "opener": r"^\d+ - ", "note": r"^\["}).where("doc = 1").orderBy("rec").collect()
    assert [(r["layer"], r["text"], r["note"]) for r in got] == [
        ("front", "intro", None), ("top", "T a", None), ("sub", "under", None), ("sub", "S b", None), ("body", "body\nmore", None), ("body", "1 - x\ny", "[1] n"), ("body", "after", None),
    ]


READING = "struct<id: string, form: string>"
ENTRIES = "match_id string, search_key string, vocalized string, freq long, voc_source string"


def ladder(spark, rows, entries, seen=None, **more):
    """{(record, i): row} of bind() over records given as lists of words."""
    inv = B.inventory(spark.createDataFrame(entries, ENTRIES))
    toks = spark.createDataFrame([(r, i, w) for r, ws in rows.items() for i, w in enumerate(ws)], "record_id string, i int, raw string")
    wit = None if seen is None else spark.createDataFrame(seen, "record_id string, i int, seen string, size int, ambiguous boolean")
    return {(r["record_id"], r["i"]): r for r in B.bind(toks, inv, witnessed=wit, **more).collect()}


TWO = [("a", "كتب", "كَتَبَ", 9, None), ("b", "كتب", "كُتُب", 3, None)]


@pytest.mark.parametrize("strict, tier", [(True, 1), (False, 2)])
def test_ladder_single_readings(spark, strict, tier):
    got = ladder(spark, {"r": ["قلم", "بيت", "دار"]}, [("q", "قلم", "قَلَمٌ", 3, "aligned:3"), ("y", "بيت", "بَيْتٌ", 3, "aligned:1,lexicon_x:2")], [("r", 0, "قَلَمٍ", 3, False)], strict=strict)
    assert (got["r", 0]["tier"], got["r", 0]["surface"], got["r", 0]["match_id"] == "q") == (tier, "قَلَمٍ", strict)
    assert (got["r", 1]["tier"], got["r", 1]["confidence"]) == (1, "medium") and (got["r", 2]["tier"], got["r", 2]["clickable"]) == (5, False)


def test_ladder_marked_and_minted(spark):
    got = ladder(spark, {"r": ["كَتَبَ", "كَتب", "قَدَمٌ"]}, TWO)
    assert [(got["r", i]["tier"], got["r", i]["confidence"], got["r", i]["surface"]) for i in range(3)] == [(0, "high", "كَتَبَ"), (0, "medium", "كَتب"), (0, "high", "قَدَمٌ")]
    assert got["r", 0]["match_id"] == "a" and got["r", 2]["match_id"].startswith("قدم#")


def test_ladder_blocks(spark):
    seen = [("r", 0, "كُتُب", 2, True), ("r", 1, "كُتُب", 2, False), ("r", 2, "كُتِبَ", 2, False), ("s", 0, "كُتِبَ", 3, False)]
    got = ladder(spark, {"r": ["كتب", "كتب", "كتب"], "s": ["كتب"]}, TWO, seen)
    assert [(got["r", i]["tier"], got["r", i]["match_id"], got["r", i]["undetermined"]) for i in (0, 1)] == [(2, "b", True), (2, "b", False)]
    # A form that a trusted block attests is minted for all, so the short block finds it too.
    assert got["s", 0]["tier"] == 2 and got["s", 0]["match_id"] == got["r", 2]["match_id"] and got["r", 2]["tier"] == 2
    bare = ladder(spark, {"r": ["كتب", "كتب"]}, TWO, [("r", 0, "كُتُب", 2, False), ("r", 1, "كُتُّب", 1, False)], curated=False)
    assert bare["r", 0]["undetermined"] and bare["r", 1]["tier"] == 2


def test_ladder_override_beats_the_witness(spark):
    son = [("u", "بن", "بْنُ", 9, None), ("i", "بن", "بْنِ", 1, None)]
    got = ladder(spark, {"r": ["عن", "زيد", "بن"], "s": ["قال", "زيد", "بن"]}, son, [("r", 2, "بْنُ", 5, False), ("s", 2, "بْنُ", 5, False)])
    assert (got["r", 2]["tier"], got["r", 2]["match_id"]) == (3, "i") and (got["s", 2]["tier"], got["s", 2]["match_id"]) == (2, "u")


def test_ladder_repairs_only_what_is_undetermined(spark):
    rows = {f"v{i}": ["رسول", "كتب"] for i in range(20)} | {"bad": ["رسول", "كتب"], "sure": ["رسول", "كتب"], "open": ["رسول", "كتب"]}
    seen = [(f"v{i}", 1, "كُتُب", 4, False) for i in range(20)] + [("bad", 1, "كَتَبَ", 2, True), ("sure", 1, "كَتَبَ", 4, False)]
    got = ladder(spark, rows, TWO, seen)
    assert [(got[k, 1]["tier"], got[k, 1]["match_id"]) for k in ("bad", "sure", "open")] == [(3, "b"), (2, "a"), (3, "b")]
    few = ladder(spark, {k: v for k, v in rows.items() if k not in ("v0", "v1", "sure")}, TWO, [x for x in seen if x[0] not in ("v0", "v1", "sure")])
    assert (few["bad", 1]["tier"], few["bad", 1]["match_id"]) == (2, "a")


def test_ladder_plausible_choice_and_corrections(spark):
    review = spark.createDataFrame([("كتب", "كُتُب"), ("x", "y")], "raw string, form string")
    assert ladder(spark, {"r": ["كتب"]}, TWO, review=review)["r", 0]["match_id"] == "b"
    assert ladder(spark, {"r": ["كتب"]}, TWO, review=review.where("raw = 'x'"))["r", 0]["match_id"] == "a"
    by_token = spark.createDataFrame([("r", 2, "كُتِبَ")], "record_id string, i int, form string")
    by_form = spark.createDataFrame([("كتب", "كُتُب", "قد", 1), ("كتب", "كَتَبَ", None, 2)], "key string, form string, after string, place int")
    got = ladder(spark, {"r": ["قد", "كتب", "كتب", "كتب"]}, TWO, by_token=by_token, by_form=by_form)
    assert [(got["r", i]["tier"], got["r", i]["match_id"][:3]) for i in (1, 2, 3)] == [(1, "b"), (1, "كتب"), (1, "a")]
    assert got["r", 2]["surface"] == "كُتِبَ" and got["r", 1]["confidence"] == "high"


def test_ladder_late_mint_and_rescue(spark):
    got = ladder(spark, {"r": ["دار", "نهر"]}, TWO, analysed=spark.createDataFrame([("دار",), (None,)], "form string"))
    assert (got["r", 0]["tier"], got["r", 0]["clickable"], got["r", 1]["clickable"]) == (5, True, False) and got["r", 0]["match_id"].startswith("دار#")
    toks = spark.createDataFrame([(4, "partial"), (5, "partial"), (5, "none"), (3, "partial")], "tier int, marks string")
    assert sorted(r["tier"] for r in B.rescued(toks).collect()) == [0, 0, 3, 5]
    assert ladder(spark, {}, TWO) == {}


def test_scored_sample(spark):
    sample = spark.createDataFrame([("s", 1), ("s", 2), ("z", 3)], "stratum string, id int")
    v = spark.createDataFrame([(1, "yes"), (2, "no"), (3, "unsure")], "id int, ok string")
    assert [tuple(r) for r in B.score_sample(sample, v, "id", "stratum", "ok").collect()] == [("s", 2, 1)]


def test_small_functions(spark):
    df = spark.createDataFrame([("«قال»", float("nan"), "12"), ("nan", 1.0, "m-1:4"), (None, None, "x")], "s string, d double, a string")
    got = df.select(X.strip_edge("s"), X.known("s"), X.known_number("d"), X.parse_selection("a", F.lit("here"))["record"], X.in_script("s")).collect()
    assert [tuple(r) for r in got] == [("قال", "«قال»", None, "here", True), ("", None, 1.0, "m-1", False), (None, None, None, None, None)]


def test_configuration(tmp_path):
    (tmp_path / "misbah.json").write_text(json.dumps({"id": "misbah", "sources": {"witness": "w.csv"}, "gates": {"witnessed": 90}}), "utf-8")
    c = config.load(f"{tmp_path}/misbah.json")
    assert c.resources().available() == [1, 2, 3, 4, 5] and c.source("inventory") is None
    with pytest.raises(KeyError):
        c.source("inventory", required=True)
    assert [config.gate(c, "witnessed", 90, 100), config.gate(c, "witnessed", 89, 100), config.gate(c, "witnessed", None, 0), config.gate(c, "other", 1, 1)] == ["PASS", "FAIL", "FAIL", "NOT_GATED"]
    (tmp_path / "other.json").write_text('{"id": "misbah"}', "utf-8")
    with pytest.raises(ValueError):
        config.load(f"{tmp_path}/other.json")


def test_every_particle_governs_its_case(spark):
    genitive = "من في على عن إلى الى مع عند بين لدى حتى منذ خلال قبل بعد فوق تحت دون سوى نحو".split()
    accusative = "إن أن كأن لكن لعل ليت إنما".split()
    key = {r["w"]: r["k"] for r in spark.createDataFrame([(w,) for w in genitive + accusative], "w string").select("w", X.fold_key("w").alias("k")).collect()}
    assert {key[w] for w in genitive} == set(ARABIC.genitive) and {key[w] for w in accusative} == set(ARABIC.accusative)
    inv = B.inventory(spark.createDataFrame([("u", "بيت", "بَيْتُ", 9), ("i", "بيت", "بَيْتِ", 1), ("a", "بيت", "بَيْتَ", 1)], "match_id string, search_key string, vocalized string, freq long"))
    toks = spark.createDataFrame([(f"{n}{w}", i, x) for n, ws in (("g", genitive), ("a", accusative)) for w in ws for i, x in enumerate((w, "بيت"))], "record_id string, i int, raw string")
    got = {r["record_id"]: (r["match_id"], r["tier"]) for r in B.bind(toks, inv).where("i = 1").collect()}
    assert got == {f"g{w}": ("i", 3) for w in genitive} | {f"a{w}": ("a", 3) for w in accusative}
