"""Scans, shredding, ranking, binder, merge, sources and streaming."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.operators import binder as B
from wordloom.operators import lexicon as L
from wordloom.operators import merge as M
from wordloom.operators import retrieve as R
from wordloom.operators.ranking import global_rank
from wordloom.operators.scan import Scan, scan
from wordloom.operators.segment import lines_of, missing_numbers, segment_records
from wordloom.operators.shred import Drift, conform, schema_graph, shred, shred_tree
from wordloom.session import latest_by
from wordloom.sources import readers


def test_scan_against_plain_loop(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab") if rng.random() < 0.9 else None, i, rng.choice([None, 1, 2]), rng.choice([None, "x", "y"])) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o int, n int, s string").repartition(7)
    outs = [Scan("n_sum", "sum", "n"), Scan("s_last", "last", "s"), Scan("s_next", "next", "s"), Scan("s_lag", "lag", "s"), Scan("s_lead", "lead", "s")]
    got = {r["o"]: tuple(r[o.name] for o in outs) for r in scan(df, ["g"], "o", outs).collect()}
    want = {}
    for g in ("a", "b", None):
        own = [r for r in rows if r[0] == g]
        for k, r in enumerate(own):
            known = [x[3] for x in own[: k + 1] if x[3]]
            ahead = [x[3] for x in own[k:] if x[3]]
            want[r[1]] = (
                sum(x[2] or 0 for x in own[: k + 1]), known[-1] if known else None, ahead[0] if ahead else None,
                own[k - 1][3] if k else None, own[k + 1][3] if k + 1 < len(own) else None,
            )
    assert got == want


def test_global_rank(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("f"), F.col("id").cast("string").alias("k"))
    got = [(r["f"], r["k"]) for r in global_rank(df, [F.col("f").desc(), F.col("k").asc()], "rank").orderBy("rank").collect()]
    assert got == sorted(got, key=lambda x: (-x[0], x[1]))
    assert global_rank(df.limit(0), [F.col("k").asc()], "rank").count() == 0


def test_latest_by_null_order_and_ties(spark):
    rows = [("a", None, 1), ("a", 5, 2), ("a", 5, 2), ("b", None, 3), (None, 9, 4)]
    got = latest_by(spark.createDataFrame(rows, "k string, t int, v int"), ["k"], "t", ["v"]).collect()
    assert sorted(map(tuple, got)) == [("a", 2), ("b", 3)]


INNER = T.StructType([T.StructField("x", T.IntegerType())])
NEST = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("one", INNER),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("kids", T.ArrayType(T.StructType([T.StructField("n", T.StringType()), T.StructField("runs", T.ArrayType(T.StringType()))]))),
    ]
)


def test_shred_links_and_positions(spark):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("pos", T.StringType()), *NEST.fields])
    rows = [("r1", "clash", "n", (7,), ["a", None], [("k0", ["u", "v"]), None, ("k2", None)]), ("r2", None, None, None, None, [])]
    t = shred(spark.createDataFrame(rows, schema), "id", schema_graph({"top": NEST}), "top")
    assert sorted(t) == ["kids", "kids_runs", "top", "top_tags"]
    assert {(r["row_key"], r["one_x"]) for r in t["top"].collect()} == {("r1", 7), ("r2", None)}
    assert [(r["row_key"], r["parent_key"], r["pos"], r["is_null"], r["n"]) for r in t["kids"].orderBy("row_key").collect()] == [
        ("r1/kids/0", "r1", 0, False, "k0"), ("r1/kids/1", "r1", 1, True, None), ("r1/kids/2", "r1", 2, False, "k2"),
    ]
    assert [(r["parent_key"], r["pos"], r["value"]) for r in t["kids_runs"].orderBy("row_key").collect()] == [("r1/kids/0", 0, "u"), ("r1/kids/0", 1, "v")]
    assert [(r["pos"], r["value"]) for r in t["top_tags"].orderBy("pos").collect()] == [(0, "a"), (1, None)]
    assert all(d.count() == 0 for d in shred(spark.createDataFrame([], schema), "id", schema_graph({"top": NEST}), "top").values())


def test_shared_struct_gets_its_own_table(spark):
    s = T.StructType([T.StructField("a", INNER), T.StructField("b", INNER)])
    g = schema_graph({"top": s})
    assert g.own_tables() == {"top", "a"}
    t = shred(spark.createDataFrame([("k", (1,), (2,))], T.StructType([T.StructField("id", T.StringType()), *s.fields])), "id", g, "top")
    assert sorted((r["row_key"], r["x"]) for r in t["a"].collect()) == [("k/a/0", 1), ("k/b/0", 2)]


@pytest.mark.parametrize(
    "body, want",
    [
        ('{"kids": {"n": "x", "runs": "v"}}', [("x", ["v"])]),
        ('{"kids": "bare"}', [("bare", None)]),
        ('{"kids": [null, {"n": 5}], "more": 1}', [None, ("5", None)]),
        ('{"kids": null}', None),
        ('{"tags": {"orth": "o"}, "kids": []}', []),
        ("{broken", None),
        ("", None),
        (None, None),
    ],
)
def test_conform_drift(spark, body, want):
    df = spark.createDataFrame([(body,)], "b string")
    got = df.select(conform(F.try_parse_json("b"), NEST, Drift({"kids": "n"}, {"tags": "orth"})).alias("x")).first()["x"]
    kids = got and got["kids"]
    assert (None if kids is None else [None if k is None else (k["n"], k["runs"]) for k in kids]) == want
    if body and "orth" in body:
        assert got["tags"] == ["o"]


def test_shred_tree_recursive(spark):
    body = '{"t": "a", "sub": [{"t": "b", "sub": {"t": "c"}}, {"t": "d"}]}'
    df = spark.createDataFrame([("r", body)], "id string, b string").select("id", F.try_parse_json("b").alias("v"))
    got = sorted((r["row_key"], r["parent_key"], r["depth"], r["t"]) for r in shred_tree(df, "id", "v", "sub", ["t"]).collect())
    assert got == [("r", None, 0, "a"), ("r/sub/0", "r", 1, "b"), ("r/sub/0/sub/0", "r/sub/0", 2, "c"), ("r/sub/1", "r", 1, "d")]


def test_p2_rules_on_a_fixture(spark, tmp_path):
    from datetime import datetime

    from wordloom.plans.dictionary import p2_found

    sense = "array<struct<label: string, level: string, runs: array<struct<t: string, v: string>>>>"
    d1, d2 = datetime(2024, 1, 1), datetime(2024, 2, 1)
    rows = [
        ("n1", "r", "h", 1, 1, ["f", " ", None], None, [("l", "x", [("t", "v"), None, ("t", " ")]), None], d1),
        ("n1", "r", "h", 1, 1, ["f", " ", None], None, [("l", "x", [("t", "v"), None, ("t", " ")]), None], d1),
        ("n2", "r", "h", 1, 1, ["old"], None, None, d1), ("n2", "r", "h", 1, 1, None, None, [], d2), (None, "r", None, None, None, ["lost"], None, None, d1),
    ]
    spark.createDataFrame(rows, f"nodeid string, root string, headword string, page int, nodenum int, forms array<string>, itypes array<string>, senses {sense}, loaded_at timestamp").write.parquet(f"{tmp_path}/entries.parquet")
    raw = [(1, "r", '{"entries": {"nodeid": "m1", "forms": {"orth": "o"}, "senses": {"runs": "v"}}}', d1), (2, None, '{"entries": [{"nodeid"', d1), (3, "r", '{"entries": [{"nodeid": "m3", "forms": "g"}]}', d1), (3, "r", "broken", d2)]
    spark.createDataFrame(raw, "raw_id long, root string, body string, loaded_at timestamp").write.parquet(f"{tmp_path}/entries_raw.parquet")
    got = sorted(map(tuple, p2_found(spark, str(tmp_path)).collect()))
    assert got == [("m1", "form", -1, 0), ("m1", "run", 0, 0), ("m1", "sense", 0, -1), ("n1", "form", -1, 0), ("n1", "run", 0, 0), ("n1", "sense", 0, -1)]


def test_bind_gives_every_token_one_tier_and_ignores_partitions(spark, sf):
    from wordloom.plans.corpus_queries import entries, words

    toks = words(spark, sf)
    inv = B.inventory(entries(spark, sf, "search_key", "vocalized", "freq"))
    a = B.bind(toks, inv)
    assert a.count() == toks.count() == a.select("record_id", "i").distinct().count()
    b = B.bind(toks.repartition(3, "raw"), inv)
    key = lambda d: sorted((r["record_id"], r["i"], r["tier"], r["match_id"]) for r in d.collect())
    assert key(a) == key(b)
    assert a.where("clickable <> (match_id is not null)").count() == 0
    assert a.where("tier = 2").count() == 0 and 2 in B.Resources().unavailable() and B.Resources(witness=True).available() == [0, 1, 2, 3, 4, 5]


def test_corrections_win(spark):
    toks = spark.createDataFrame([("r", 0, "قال")], "record_id string, i int, raw string")
    inv = B.inventory(spark.createDataFrame([("قال#1", "قال", "قَالَ", 5)], "match_id string, search_key string, vocalized string, freq long"))
    fix = spark.createDataFrame([("r", 0, "قِيلَ")], "record_id string, i int, form string")
    got = B.bind(toks, inv, by_token=fix).first()
    assert got["match_id"].startswith("قال#") and got["match_id"] != "قال#1" and got["tier"] == 1


@pytest.mark.parametrize("lead", [0.01, 0.5, 1.0])
def test_retrieval_is_that_of_scoring_everything(spark, monkeypatch, lead):
    import math

    monkeypatch.setattr(R, "LEAD", lead)
    rng = random.Random(12)
    vocab = [f"k{i}" for i in range(60)]
    qs = {f"q{i:02}": set(rng.choices(vocab, k=rng.choice([1, 4, 12]))) for i in range(40)}
    rs = {f"w{i:02}": set(rng.choices(vocab, weights=[1 + 30 // (j + 1) for j in range(60)], k=15)) for i in range(50)}
    df = {k: sum(k in ws for ws in rs.values()) for k in vocab}
    idf = {k: round(math.log(len(rs) / n) * 1_000_000) for k, n in df.items() if 0 < n <= 20}
    want = {}
    for q, ks in qs.items():
        score = {w: sum(idf[k] for k in ks & ws if k in idf) for w, ws in rs.items() if any(k in idf for k in ks & ws)}
        if score:
            w = min(score, key=lambda w: (-score[w], w))
            want[q] = (w, score[w], len(ks & rs[w]) * 1_000_000 // len(ks))
    flat = lambda d, name: spark.createDataFrame([(a, k) for a, ks in d.items() for k in ks], f"{name} string, key string")
    got = {r["query_id"]: (r["row_id"], r["score"], r["coverage_ppm"]) for r in R.retrieve(flat(qs, "query_id"), flat(rs, "row_id"), cap=20).collect()}
    assert got == want


def test_retrieval_ties_and_order(spark):
    q = spark.createDataFrame([("q", k) for k in "abc"], "query_id string, key string")
    r = spark.createDataFrame([(w, k) for w in ("w2", "w1") for k in "abc"] + [("w3", "z")], "row_id string, key string")
    for rows in (r, r.orderBy("key").repartition(5)):
        got = R.retrieve(q, rows).collect()
        assert [(g["row_id"], g["coverage_ppm"], g["accepted"]) for g in got] == [("w1", 1_000_000, True)]
    assert R.retrieve(q.limit(0), r).count() == 0


def test_align_is_longest_block_first(spark):
    df = spark.createDataFrame([("q", "w", list("abxcd"), list("abcd"))], "query_id string, row_id string, a array<string>, b array<string>")
    assert [tuple(m) for m in R.align(df).first()["blocks"]] == [(0, 0, 2), (3, 2, 2)]


def test_digest_of_a_million_rows_in_a_group(spark):
    rows = spark.range(1_000_000).select(F.lit("g").alias("g"), "id")
    one, two = (M.content_digest(d, ["g"], ["id"]).first() for d in (rows, rows.repartition(7)))
    assert one == two and one["rows"] == 1_000_000 and 0 <= one["digest"] < M.DIGEST_MOD
    assert M.content_digest(rows.where("id > 0"), ["g"], ["id"]).first()["digest"] != one["digest"]


def test_merge_is_idempotent_and_digest_ignores_order(spark):
    base = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, v int, s string")
    top = spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int")
    once = M.overlay(base, top, "k")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, M.overlay(once, top, "k").collect())) == [("a", 1, "x"), ("b", 9, None), ("c", 3, None)]
    d = lambda x: [tuple(r) for r in M.content_digest(x, [], ["k", "v", "s"]).collect()]
    assert d(base) == d(base.orderBy(F.desc("k"))) != d(once)
    got = M.merge_shared(spark.createDataFrame([("k", "b", "n", None, "g"), ("k", "a", "n", "l", None), ("z", "a", "n", "l", None), ("z", "b", "v", "m", None)], "k string, c string, p string, l string, g string"), "k", F.col("c"), ["p"], ["l", "g"])
    assert sorted(map(tuple, got.collect()), key=str) == [("k", False, "l", "g"), ("z", True, None, None)]


def test_wilson_and_empty_lexicon(spark):
    df = spark.createDataFrame([(0, 0), (9, 10)], "k int, n int")
    low, high = M.wilson(F.col("k"), F.col("n"))
    got = [tuple(r) for r in df.select(low, high).collect()]
    assert got[0] == (None, None) and abs(got[1][0] - 0.5958) < 1e-3 and abs(got[1][1] - 0.9821) < 1e-3
    empty = spark.createDataFrame([], "corpus string, key string, record_id string, seq long, i int")
    assert L.word_stats(empty, ["key"]).count() == 0 and L.inverted_index(empty).count() == 0


def test_lines_and_numbers(spark):
    df = spark.createDataFrame([(1, "front\r\n1 - a\nb\nباب x\nc"), (2, ""), (3, None)], "doc_id int, text string")
    got = segment_records(df, "doc_id", "text", lambda x: x.rlike(r"^\d+ - "), lambda x: x.rlike("^باب")).orderBy("doc_id", "rec").collect()
    assert [(r["doc_id"], r["rec"], r["kind"], r["lines"]) for r in got] == [(1, 0, "front", 1), (1, 1, "opener", 2), (1, 2, "heading", 2), (2, 0, "front", 1)]
    nums = spark.createDataFrame([("c", 1), ("c", 3), ("c", 3), ("c", 6), ("d", None)], "corpus string, number int")
    assert sorted(r["number"] for r in missing_numbers(nums, "corpus", "number", span=2).collect()) == [2, 4, 5]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "book.txt").write_text("#META# title :: X\n#META# date :: NODATA\n#META#Header#End#\n# body\n~~ more", "utf-8")
    (tmp_path / "none.txt").write_text("no header", "utf-8")
    got = readers.text_files(spark, f"{tmp_path}/*.txt")
    assert got.where("body is null").count() == 1
    assert [tuple(r)[1:] for r in readers.header_fields(got, "path", "header").collect()] == [("title", "X")]
    (tmp_path / "w.json").write_text('{"hadiths": [{"id": 2, "arabic": "b"}, {"id": 1, "arabic": "a"}, {"id": 3, "arabic": " "}]}', "utf-8")
    assert [r["text"] for r in readers.witness_units(spark, f"{tmp_path}/w.json").orderBy("unit_no").collect()] == ["a", "b"]
    (tmp_path / "w.csv").write_text('text\n"a, b"\n""\n', "utf-8")
    assert [r["text"] for r in readers.witness_units(spark, f"{tmp_path}/w.csv").collect()] == ["a, b"]
    before = readers.manifest(spark, f"{tmp_path}/*.txt").cache()
    assert before.count() == 2
    (tmp_path / "book.txt").write_text("changed", "utf-8")
    assert [tuple(r) for r in readers.changed(readers.manifest(spark, f"{tmp_path}/book.txt"), before).orderBy("file").collect()] == [("book.txt", "changed"), ("none.txt", "gone")]
    out = f"{tmp_path}/shards"
    readers.write_shards(spark.createDataFrame([("x", 0), ("y", 1)], "v string, shard int"), out, "shard")
    readers.write_shards(spark.createDataFrame([("z", 1)], "v string, shard int"), out, "shard")
    assert sorted(r["v"] for r in spark.read.json(out).collect()) == ["x", "z"]
    assert readers.check_contract(spark.createDataFrame([(1,)], "a int"), T.StructType([T.StructField("b", T.StringType())])) == ["missing b", "extra a"]


def test_input_manifest_covers_every_input(spark, sf):
    import hashlib
    import pathlib

    import __spark_entry__ as entry

    got = sorted((r["file"], r["bytes"], r["sha256"]) for r in entry.queries()["input_manifest"](spark, sf).collect())
    files = [p for p in pathlib.Path(sf).rglob("*") if p.is_file()]
    assert got == sorted((str(p.relative_to(sf)), p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in files)


def test_stream_counts_match_batch(spark, tmp_path, sf):
    from wordloom.functions import text as X
    from wordloom.streaming import upsert as U

    src = spark.read.parquet(f"{sf}/records.parquet").select("id", "textraw", "loaded_at").dropDuplicates(["id"])
    src.unionByName(src.limit(10)).repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    U.append_batches(U.token_stream(stream, late="4000 days"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = {r["word"]: (r["freq"], r["doc_freq"]) for r in U.totals(spark.read.parquet(f"{tmp_path}/out")).collect()}
    per = spark.read.parquet(f"{tmp_path}/in").dropDuplicates(["id"]).select("id", F.explode(F.transform(X.tokens_of("textraw"), lambda t: X.fold_key(t["raw"]))).alias("w"))
    want = {r["w"]: (r["f"], r["d"]) for r in per.groupBy("w").agg(F.count(F.lit(1)).alias("f"), F.count_distinct("id").alias("d")).collect()}
    assert got == want


def test_stream_loses_no_late_record(spark, tmp_path):
    from datetime import datetime

    from wordloom.streaming import upsert as U

    d = lambda m: datetime(2024, m, 1)
    batches = [
        [("a", "كتب", d(10)), ("b", "قال", d(9)), ("g", "كتب", d(1))],
        [("c", "كتب كتب", d(3)), ("a", "قديم", d(2)), ("b", "قلم", d(10)), ("n", "كتب", None)],
        [("a", "كتب", d(10)), ("d", "قلم", d(3)), ("d", "قلم", d(3)), ("g", "", d(2)), (None, "كتب", d(3))],
    ]
    schema = "id string, textraw string, loaded_at timestamp"
    # One run a batch, so that the batches come in this order.
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        U.append_batches(U.token_stream(stream), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = sorted(map(tuple, U.totals(spark.read.parquet(f"{tmp_path}/out")).collect()))
    assert got == [("قلم", 2, 2), ("كتب", 4, 3)]


def test_postings_keep_keys_of_21_to_400_records(spark, tmp_path, sf):
    import __spark_entry__ as entry

    rows = [(f"r{i:03}", "c", "matn", i, "كتب" if i < 400 else "قلم", 1) for i in range(430)] + [(f"q{i:03}", "c", "matn", 500 + i, "بحر", 1) for i in range(401)]
    df = spark.createDataFrame(rows, "id string, corpus string, layer string, seq long, textraw string, tokens int")
    have = spark.read.parquet(f"{sf}/records.parquet")
    more = [F.lit(None).cast(f.dataType).alias(f.name) for f in have.schema.fields if f.name not in df.columns]
    df.select("*", *more).write.parquet(f"{tmp_path}/records.parquet")
    got = {r["key"]: (r["df"], len(r["records"].split())) for r in entry.queries()["postings"](spark, str(tmp_path)).collect()}
    assert got == {"كتب": (400, 400), "قلم": (30, 30)}
