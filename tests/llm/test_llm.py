"""The training-data operators: brute force on small fixtures, and the defined result of every odd input."""

import random
from collections import Counter, defaultdict
from datetime import datetime

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wordloom.llm import encode as E
from wordloom.llm import linkage as K
from wordloom.llm import lookalike as U
from wordloom.llm import mix as X
from wordloom.llm import registry
from wordloom.llm import spam as S
from wordloom.llm import term_counts as C
from wordloom.llm import top_n as N

D1, D2 = datetime(2024, 1, 1), datetime(2024, 2, 1)


def tuples(df):
    return sorted(map(tuple, df.collect()), key=str)


# 1 ---------------------------------------------------------------------------------------------------------------
def brute_top(rows, n):
    by = defaultdict(list)
    for g, s, i in rows:
        if None not in (g, s, i):
            by[g].append((-s, i))
    return sorted(((g, k + 1, i) for g, v in by.items() for k, (_, i) in enumerate(sorted(v)[:n])), key=str)


@pytest.mark.parametrize("heavy", [1, 20, 10_000])
def test_top_n_hot_and_cold(spark, heavy):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 5 + ["a", "b", "c", None]), rng.choice([None, 1, 2, 3, 9]), f"m{rng.randrange(400)}") for _ in range(900)]
    df = spark.createDataFrame(rows, "g string, s long, m string").withColumn("place", F.lit("clash")).withColumn("h", F.lit(1)).withColumn("cells", F.lit(1))
    for listed in (1, 500_000):
        assert tuples(N.top_n_per_group(df, "g", "s", "m", 3, heavy_rows=heavy, listed=listed)) == brute_top(rows, 3)


def test_top_n_of_equal_rows_in_a_heavy_group(spark):
    df = spark.createDataFrame([("g", 1, "a")] * 500 + [("g", 1, "b")], "g string, s long, m string")
    assert tuples(N.top_n_per_group(df, "g", "s", "m", 3, heavy_rows=50)) == [("g", k, "a") for k in (1, 2, 3)]


def test_top_n_empty_and_small(spark):
    df = spark.createDataFrame([], "g string, s long, m string")
    assert N.top_n_per_group(df, "g", "s", "m", 3).count() == 0
    one = spark.createDataFrame([("g", 1, "b"), ("g", 1, "a")], "g string, s long, m string")
    assert tuples(N.top_n_per_group(one, "g", "s", "m", 3)) == [("g", 1, "a"), ("g", 2, "b")]
    with pytest.raises(ValueError):
        N.top_n_per_group(one, "g", "s", "m", 0)


# 4 ---------------------------------------------------------------------------------------------------------------
def test_term_counts_brute(spark):
    rng = random.Random(2)
    rows = [(i, None if rng.random() < 0.1 else [rng.choice(["x", "x", "y", "", None, f"t{rng.randrange(30)}"]) for _ in range(rng.randrange(40))]) for i in range(300)]
    freq, docs = Counter(), Counter()
    for _, ts in rows:
        known = [t for t in ts or [] if t is not None]
        freq.update(known)
        docs.update(set(known))
    tokens = [(i, t) for i, ts in rows for t in ts or []] + [(None, "x")]
    rng.shuffle(tokens)
    df = spark.createDataFrame(tokens, "id long, t string").withColumn("term", F.lit("clash")).withColumn("record", F.lit(1))
    want = sorted(((t, freq[t], docs[t]) for t in freq), key=str)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("10000", "7", "1"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        assert tuples(C.term_counts(df, "t", "id")) == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert C.term_counts(df.limit(0), "t", "id").count() == 0


def test_marks(spark):
    df = spark.createDataFrame([("a", 9, 1), ("b", 2, 2), ("c", 2, 3)], "term string, freq long, doc_freq long")
    assert [r["mark"] for r in C.mark_terms(df, F.lit(11)).orderBy("term").collect()] == ["rare", None, "common"]
    assert [r["mark"] for r in C.mark_terms(df, F.lit(10)).orderBy("term").collect()] == ["rare", "common", "common"]


# 5 ---------------------------------------------------------------------------------------------------------------
ALIKE = [
    ("ﻛﺘﺎﺏ", "كتاب"), ("ك‍تاب", "كتاب"), ("کتاب", "كتاب"), ("بیت", "بيت"), ("علی", "على"), ("دە", "ده"), ("أ", "أ"), ("إن", "إن"), ("(2)", "（２）"),
    ("و ٢", "و ۲"), ("مَّ", "مَّ"), (" كتاب", "كتاب"), ("كتاب لي", "كتاب لي"), ("﻿كتاب​", "كتاب"), ("ئ", "ئ"), ("café", "café"),
]
UNLIKE = [("على", "علي"), ("كتابة", "كتابه"), ("أن", "إن"), ("ٱلكتاب", "الكتاب"), ("٤", "۴"), ("2", "٢"), ("کـ", "كك"), ("ملک", "ملك"), ("بَ", "بِ"), ("كتاب لي", "كتابلي"), ("ب", "ت"), ("دهر", "دەر")]


@pytest.mark.parametrize("a, b", ALIKE)
def test_alike(a, b):
    t = U.compiled()
    assert t(a) == t(b)
    assert t(t(a)) == t(a)


@pytest.mark.parametrize("a, b", UNLIKE)
def test_unlike(a, b):
    t = U.compiled()
    assert t(a) != t(b)


def test_transducer_edges():
    t = U.compiled()
    assert t(None) is None and t("") == "" and t("​‏") == "" and t("  ") == ""
    assert len(t("ك" * 200_000)) == 200_000
    for same, place in (({"x": "y", "y": "z"}, []), ({"x": "é"}, []), ({"x": "a"}, [("x", "b", None)])):
        with pytest.raises(ValueError):
            U.Transducer(same, place)


def test_same_looking_pairs(spark):
    rows = [("a", "كتاب", "x"), ("b", "کتاب", "x"), ("c", "كتاب", "x"), ("d", "ﻛﺘﺎﺏ", None), ("e", "كتاب", "y"), ("a", "كتاب", "x"), (None, "كتاب", "x"), ("b", "كتاب", "x")]
    df = spark.createDataFrame(rows, "m string, f string, g string").withColumn("looks", F.lit(1)).withColumn("f0", F.lit("clash"))
    assert tuples(U.same_looking_pairs(df, "m", ["f", "g"])) == [("a", "b"), ("b", "c")]
    assert U.same_looking_pairs(df.limit(0), "m", ["f", "g"]).count() == 0
    got = {(r["item"], r["links"]) for r in U.same_looking_classes(df, "m", ["f", "g"]).collect()}
    assert got == {("a", 1), ("b", 0), ("b", 2), ("c", 1), ("e", 0)}


def test_transducer_composes_as_unicode_does():
    import unicodedata

    rng = random.Random(8)
    t = U.compiled()
    plain = [chr(c) for c in [*range(0x61, 0x7B), *range(0x621, 0x64B)] if chr(c) not in t.single]
    marks = [chr(c) for c in [*range(0x300, 0x310), 0x323, *range(0x64B, 0x656), 0x670] if chr(c) not in t.single]
    for _ in range(3000):
        text = "".join(rng.choice(plain) + "".join(rng.choices(marks, k=rng.choice([0, 1, 1, 2, 3]))) for _ in range(3))
        want = unicodedata.normalize("NFC", text).replace(*U.SEATED)
        assert t(text) == want or U.SEATED[0][0] in text
        assert t(t(text)) == t(text)
    # Every entry of the whole mapping goes through again unchanged.
    assert all(t(t(c)) == t(c) for c in t.single)


# 6 ---------------------------------------------------------------------------------------------------------------
TEXTS = ["", None, " ", "\n\n  x", "it's <|endoftext|> 12  ", "قال: نَعَم‍", "é é 中文 😀", "a" * 50_000, "''s !'re", "نص " * 20_000, "  x\r\n"]


@pytest.mark.parametrize("block", [1, 40, 4_000_000])
def test_encode_is_exact_whatever_the_blocks(spark, block):
    rows = list(enumerate(TEXTS * 2)) + [(None, "null key"), (0, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("block", F.lit("clash"))
    plain = E.encoder(E.Vocab.byte_bpe_50k())
    want = sorted(((k, plain(t) if t else []) for k, t in rows), key=str)
    assert tuples(E.encode_corpus(df, "doc_id", "text", block_chars=block)) == want
    assert tuples(E.token_counts(df, "doc_id", "text", block_chars=block)) == sorted(((k, len(i)) for k, i in want), key=str)


def test_encode_agrees_with_the_other_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{E.tokenizer_dir()}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    plain = E.encoder(E.Vocab.byte_bpe_50k())
    for x in TEXTS:
        assert plain(x or "") == t.encode(x or "", add_special_tokens=False).ids


def test_decode_round_trip_and_edges(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    back = {r["id"]: r["text"] for r in E.decode_corpus(E.encode_corpus(df, "doc_id", "text"), "id", "ids").collect()}
    assert back == {k: t or "" for k, t in enumerate(TEXTS)}
    odd = spark.createDataFrame([(1, None), (2, []), (3, [234])], "id long, ids array<int>")
    assert [r["text"] for r in E.decode_corpus(odd, "id", "ids").orderBy("id").collect()] == [None, "", "�"]
    assert E.encode_corpus(df.limit(0), "doc_id", "text").count() == 0


# 7 ---------------------------------------------------------------------------------------------------------------
def test_flight_keeps_both_totals():
    rng = random.Random(5)
    size = [float(rng.choice([10, 10, 10, 900, rng.randrange(1, 5000)])) for _ in range(2000)]
    prob = [rng.random() for _ in size]
    out = X.flight(size, prob, random.Random(1))
    assert abs(sum(a * b for a, b in zip(size, out)) - sum(a * b for a, b in zip(size, prob))) < 1e-3
    assert abs(sum(out) - sum(prob)) < 1e-6
    assert sum(0 < x < 1 for x in out) <= 2
    landed = X.landing(size, out)
    assert set(landed) <= {0.0, 1.0} and abs(sum(a * b for a, b in zip(size, landed)) - sum(a * b for a, b in zip(size, prob))) < 50


def test_flight_keeps_probabilities():
    hits = Counter()
    for k in range(3000):
        hits.update(i for i, x in enumerate(X.landing([3.0, 3.0, 3.0, 3.0], X.flight([3.0] * 4, [0.5, 0.25, 0.75, 0.5], random.Random(k)))) if x)
    assert all(abs(hits[i] / 3000 - p) < 0.05 for i, p in enumerate([0.5, 0.25, 0.75, 0.5]))


@pytest.mark.parametrize("cell", [40, 20_000])
def test_mix_reaches_its_shares(spark, cell):
    rng = random.Random(7)
    rows = [(i, rng.choice(["big"] * 8 + ["mid", "mid", "tiny"]), rng.randrange(1, 400)) for i in range(3000)]
    rows += [(9001, None, 5), (9002, "big", 0), (9003, "other", 9), (9004, "big", None), (9005, "big", 9000)]
    sizes = spark.createDataFrame(rows, "id long, source string, n_tokens long").withColumn("p", F.lit(1)).withColumn("cell", F.lit("clash"))
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.15, 3), ("none", 0.05, 4), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    got = X.mix(sizes, targets, cell_rows=cell)
    again = X.mix(sizes.repartition(7), targets, cell_rows=cell)
    assert tuples(got) == tuples(again)
    cap = {"big": 1, "mid": 2, "tiny": 3}
    assert all(1 <= r["copies"] <= cap[r["source"]] for r in got.collect())
    rep = {r["source"]: r for r in X.shares(got, sizes, targets.where("source is not null")).collect()}
    for s in cap:
        assert abs(rep[s]["share_reached"] - rep[s]["share_possible"]) < 2e-3
    assert rep["none"]["share_reached"] == 0


def test_mix_lands_each_source_by_its_own_size(spark):
    rng = random.Random(11)
    rows = [(f"{s}{i}", s, int(rng.lognormvariate(6, 1)) + 1) for s, n in (("large", 1300), ("small", 75), ("mid", 400)) for i in range(n)]
    sizes = spark.createDataFrame(rows, "id string, source string, n_tokens long")
    tokens = {s: sum(n for _, x, n in rows if x == s) for s in ("large", "small", "mid")}
    whole = sum(tokens.values())
    targets = spark.createDataFrame([(s, n / whole, 3) for s, n in tokens.items()], "source string, target_share double, max_repeats int")
    got = X.mix(sizes, targets, total=1.3 * whole, cell_rows=500)
    taken = {r["source"]: r["t"] for r in got.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("t")).collect()}
    assert all(abs(taken[s] - 1.3 * n) <= max(0.0005 * n, 2) for s, n in tokens.items()), (taken, tokens)
    again = X.mix(sizes.repartition(7), targets, total=1.3 * whole, cell_rows=500)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))


def test_landing_puts_tokens_first():
    # One in at 0.5 of nine equal texts and one long one: no count of texts is kept at the tokens' cost.
    for size, prob in (([900.0, 100, 100, 100, 100], [0.5, 0, 1, 0, 1]), ([5.0, 7, 11, 13, 500], [0.3, 0.6, 1, 0, 0])):
        want = sum(a * b for a, b in zip(size, prob))
        got = X.landing(size, prob)
        best = min(abs(sum(s for k, s in enumerate(size) if m >> k & 1) - want) for m in range(32))
        assert set(got) <= {0.0, 1.0} and abs(sum(a * b for a, b in zip(size, got)) - want) <= best + 50


def test_mix_of_null_and_repeated_ids(spark):
    rows = [(None, "a", 10)] * 5 + [(1, "a", 10)] * 5 + [(2, "b", 100)]
    sizes = spark.createDataFrame(rows, "id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    got = X.mix(sizes, targets)
    assert got.where("source = 'a'").agg(F.sum(F.col("n_tokens") * F.col("copies"))).first()[0] == 100 and got.count() == 11


def test_trade(spark):
    sizes = spark.createDataFrame([(1, "a", 100), (2, "b", 100), (3, "c", 0)], "id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.25, 2), ("c", 0.25, 1)], "source string, target_share double, max_repeats int")
    got = {r["source"]: (r["total_at_cap"], r["sets_total"], r["tokens_then"], r["short_then"]) for r in X.trade(sizes, targets).collect()}
    assert got == {"a": (200, True, 150, 0.0), "b": (800, False, 300, 0.375)}


def test_mix_empty(spark):
    sizes = spark.createDataFrame([], "id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert X.mix(sizes, targets).count() == 0
    assert X.mix(spark.createDataFrame([(1, "a", 5)], sizes.schema), targets.limit(0)).count() == 0


# 8 ---------------------------------------------------------------------------------------------------------------
def prose(rng, n=70):
    f, c = "the a of and in to is that it as was for with on by this".split(), [f"{a}{b}{e}" for a in "bcdfglmnprst" for b in "aeiou" for e in ("nd", "rk", "lt", "mp")]
    words = [rng.choice(f) if rng.random() < 0.45 else rng.choice(c) for _ in range(n)]
    return " ".join(w + ("." if i % 12 == 11 else "") for i, w in enumerate(words))


def test_spam_pages(spark):
    rng = random.Random(3)
    good = {f"p{i}": prose(rng) for i in range(300)}
    good["few links"] = prose(rng) + " (https://a.example/x). " + prose(rng)
    refrain = "of the grand sand"
    good["litany"] = "\n".join(f"{prose(rng, 6)} {refrain}\n{refrain}" for _ in range(12))
    good["notes"] = prose(rng) + "".join(f"\n[{i}] {prose(rng, 12)} https://a.example/{i}" for i in range(5))
    good["empty"], good["null"], good["marks"] = "", None, "... !!"
    keys = ["cheap lamp", "buy lamp", "lamp oil"]
    bad = {
        "stuffed": " ".join(rng.choice(keys) for _ in range(60)),
        "hidden": " ".join("​".join(rng.choice(keys)) for _ in range(60)),
        "between": prose(rng, 20) + "\n" + " | ".join(rng.choice(keys) for _ in range(80)) + "\n" + prose(rng, 10),
        "links": "\n".join(f"https://a.example/{i}" for i in range(30)),
        "tags": " ".join(f"#{w}" for w in prose(rng, 40).replace(".", "").split()),
        "titles": "\n".join(f"[lamp](https://a.example/{i})" for i in range(30)),
    }
    df = spark.createDataFrame([*good.items(), *bad.items()], "doc_id string, text string").withColumn("id", F.lit(1)).withColumn("cls", F.lit("clash"))
    found = {r["id"] for r in S.page_scores(df, "doc_id", "text").where("is_spam").collect()}
    assert found == set(bad)


def test_spam_edges(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "doc_id long, text string")
    assert S.page_scores(df, "doc_id", "text").where("is_spam").count() == 0
    assert S.page_scores(df.limit(0), "doc_id", "text").count() == 0
    assert read("lamp " * 300_000, [])[0] == "K" * 300_000
    assert read("[" + "a " * 400 + "](https://a.example/x)", [])[0::2] == ("U", [400])
    assert read("[" * 200_000, [])[0] == "" and read(None, [])[0] == ""


def test_few_lists_among_many_pages(spark):
    """Lists on a few of very many training pages do not make lists foreseeable, as they would not in a small corpus."""
    import numpy as np

    rng = random.Random(8)
    clean = ["".join(rng.choice(["CFC", "FCC", "CCF", "CFP", "CMF"]) for _ in range(12)) for _ in range(2000)]
    links = lambda n: "".join("U" * rng.randint(3, 6) + rng.choice(["C", "CC", "FC", "CF"]) for _ in range(n))
    listed = [clean[0] + links(20)]
    pages = [links(6), "CFCFP" + links(8), clean[0]]
    found = []
    for copies, some in ((1, []), (10, listed)):
        cls = clean * copies + some
        rows = spark.createDataFrame([(c, np.ones(len(c), "<i4").tobytes(), "text") for c in cls], "cls string, weight binary, layout string")
        share, _ = S.Pages(pages, ["text"] * 3).abnormal(*S._fit(rows), np.ones(sum(map(len, pages))))
        found.append((share > S.MAJORITY).tolist())
    assert found == [[True, True, False]] * 2


def read(text, function):
    """(classes, words, weights) of one page."""
    import numpy as np

    got = S.read_batch([None, text, "x"])
    cls = S.class_batch(got["kinds"].to_pylist(), got["codes"].to_pylist(), got["words"], pa.array(function, pa.string()))
    return cls[1], got["words"][1].as_py(), np.frombuffer(got["weight"][1].as_py(), "<i4").tolist()


def test_classes_of_a_page():
    assert read("The cat, the dog.\n12 #tag | https://a.example/x", ["the"])[0] == "FCMFCPBNTSU"
    # Cited after seven words of its line; not after six, nor when a line or link lies between.
    words = "one two three four five six"
    for text, want in ((f"{words} seven https://a.example", "CCCCCCCL"), (f"{words} https://a.example", "CCCCCCU"), (f"{words} seven\nhttps://a.example", "CCCCCCCBU"), (f"{words} seven https://a.example/1 https://a.example/2", "CCCCCCCLU")):
        assert read(text, [])[0] == want
    assert read("lamp oil lamp oil lamp oil lamp", [])[0] == "KCKCKCK"
    lines = [f"w{chr(97 + i)} x{chr(97 + i)} of the grand sand" for i in range(6)]
    assert read("\n".join(lines), ["of", "the"])[0] == "B".join(["CCEEEE"] * 6)
    assert sorted(read("b a b", [])[1]) == ["a", "b"]


def test_perplexity_is_of_trigrams():
    import numpy as np

    pages = S.Pages(["FCFCPB" * 50, "", "UB" * 10], ["text", "text", "verse"])
    counts = np.bincount(pages.grams[:300], minlength=S._N**3)
    assert {S.gram_name(int(g)) for g in np.flatnonzero(counts)} == {"^^F", "^FC", "FCF", "CFC", "FCP", "CPB", "PBF", "BFC"}
    models = np.array([S.log_probabilities(counts)] * len(S.LAYOUTS))
    page, start, end, score = pages.windows(pages.surprise(models))
    assert score[page == 0].max() < 1.2 < score[page == 2].min() and not (page == 1).any()
    # Against a plain loop: the windows of a page cover it and step evenly, the last one ends with it.
    for n in (1, 15, 16, 17, 24, 25, 40, 41):
        _, a, b, _ = S.Pages(["C" * n], ["text"]).windows(np.zeros(n))
        want = list(range(0, max(1, n - S.WINDOW + 1), S.STEP))
        want += [n - S.WINDOW] if n > S.WINDOW and want[-1] + S.WINDOW < n else []
        assert a.tolist() == want and b.tolist() == [min(x + S.WINDOW, n) for x in want]


def test_function_words_are_each_languages_own(spark):
    rng = random.Random(9)
    rows = [(lang, " ".join(rng.choice(f) if rng.random() < 0.4 else f"{lang.lower()}{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(80))) for lang, f in (("en", ["the", "of"]), ("EN", ["the", "of"]), ("xx", ["ka", "ko"])) for _ in range(50)]
    df = spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(rows)], "id long, lang string, text string")
    read = df.mapInArrow(S._tokenise, "id long, lang string, kinds string, codes binary, words array<string>, times array<int>, weight binary")
    assert {r["word"] for r in S.function_words(read).collect()} <= {"the", "of", "ka", "ko"}
    assert len(S.function_words(read).collect()) >= 2 and S.function_words(read.limit(0)).count() == 0


# 3 ---------------------------------------------------------------------------------------------------------------
def test_common_words_is_lcs():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert K.common_words(a, b) == t[-1][-1]


def world(seed=6, n=120):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("بتثجحخدذرزسشصضطظعغ") for _ in range(5)) for _ in range(600)]
    return rng, vocab, [[rng.choice(vocab) for _ in range(30)] for _ in range(n)]


R_SCHEMA, W_SCHEMA = "id string, collection string, seq long, number int, chapter string, text string", "id string, source string, number int, chapter string, text string"


def test_linkage(spark):
    rng, vocab, texts = world()
    texts[100] = texts[50][:]  # a near copy elsewhere
    texts[100][3] = vocab[0]
    recs = [(f"r{i:03}", "c", i, i + 1 if i % 9 else None, f"باب {i // 10}", " ".join(t)) for i, t in enumerate(texts)]
    recs += [("r-null", "c", 900, 901, None, None), ("r-empty", "c", 901, 902, None, "")]
    rows, want = [], set()
    for i, t in enumerate(texts):
        if i % 3 == 0:
            continue
        noisy = [w if rng.random() > 0.1 else rng.choice(vocab) for w in t]
        part = noisy if i % 4 else noisy[:18]
        rows.append((f"w{i:03}", "e", i + 3 if i % 7 else None, f"باب {i // 10}" if i % 5 else None, " ".join(part)))
        want.add((f"r{i:03}", f"w{i:03}"))
    rows.append(("w-two", "e", 24, "باب 2", " ".join(texts[21] + texts[22])))
    want |= {("r021", "w-two"), ("r022", "w-two")}
    rows.append(("w-copy", "e", 53, "باب 5", " ".join(texts[50])))
    want.add(("r050", "w-copy"))
    rows.append(("w-stretch", "e", 999, None, " ".join(texts[5][:12] + [rng.choice(vocab) for _ in range(20)])))
    rows += [("w-null", "e", 1, None, None), ("w-empty", "e", 1, None, ""), ("w-none", "e", 7, None, " ".join(rng.choice(vocab) for _ in range(30)))]
    r = spark.createDataFrame(recs, R_SCHEMA).withColumn("weight", F.lit("clash"))
    w = spark.createDataFrame(rows, W_SCHEMA).withColumn("h0", F.lit("clash"))
    got = K.link(r, w)
    assert {(x["record_id"], x["witness_id"]) for x in got.collect()} == want
    assert all(0 < x["confidence"] <= 1 for x in got.collect())


@pytest.mark.parametrize("bound, crowd", [(4096, 100_000), (16, 100_000), (16, 20)])
def test_linkage_of_copies_goes_by_place(spark, monkeypatch, bound, crowd):
    monkeypatch.setattr(K, "BOUND", bound)
    monkeypatch.setattr(K, "CROWD", crowd)
    _, _, texts = world()
    recs = [(f"r{i:03}", "c", i, i * 60, f"باب {i}", " ".join(texts[0])) for i in range(30)]
    rows = [(f"w{i:03}", "e", i * 60 + 1, None, " ".join(texts[0])) for i in range(30)]
    got = K.link(spark.createDataFrame(recs, R_SCHEMA), spark.createDataFrame(rows, W_SCHEMA))
    assert {(x["record_id"], x["witness_id"]) for x in got.collect()} == {(f"r{i:03}", f"w{i:03}") for i in range(30)}


@pytest.mark.parametrize("n", [60, 70, 5000])
def test_linkage_of_copies_without_places_takes_the_lowest(spark, n):
    _, _, texts = world()
    recs = [(f"r{i:04}", "c", i, None, None, " ".join(texts[0])) for i in range(n)]
    got = K.link(spark.createDataFrame(recs, R_SCHEMA), spark.createDataFrame([("w0", "e", None, None, " ".join(texts[0]))], W_SCHEMA))
    assert [(x["record_id"], x["witness_id"]) for x in got.collect()] == [("r0000", "w0")]


@pytest.mark.parametrize("crowd", [100_000, 150])
def test_linkage_of_near_copies_in_bounded_edges(spark, monkeypatch, crowd):
    monkeypatch.setattr(K, "CROWD", crowd)
    rng, vocab, texts = world()
    changed = lambda k: " ".join(w if i != 15 else f"{vocab[k]}{vocab[k + 1]}" for i, w in enumerate(texts[0]))
    recs = [(f"r{i:03}", "c", i, i + 1, None, changed(i)) for i in range(200)]
    rows = [(f"w{i:03}", "e", i + 1, None, changed(i) if i % 2 else " ".join(texts[0][:14])) for i in range(200)]
    got = K.link(spark.createDataFrame(recs, R_SCHEMA), spark.createDataFrame(rows, W_SCHEMA))
    assert {(x["record_id"], x["witness_id"]) for x in got.collect()} == {(f"r{i:03}", f"w{i:03}") for i in range(200)}


@pytest.mark.parametrize("bound, crowd", [(4096, 100_000), (16, 100_000), (16, 20)])
def test_linkage_of_copies_without_a_usable_place(spark, monkeypatch, bound, crowd):
    monkeypatch.setattr(K, "BOUND", bound)
    monkeypatch.setattr(K, "CROWD", crowd)
    _, _, texts = world()
    copy, around = " ".join(texts[0]), [" ".join(t) for t in texts[1:13]]
    recs = [(f"r{i:03}", "c", i, i * 60, f"كتاب الباب {'ابتثجحخدذرزسشصضطظعغفقكلمنهوي'[i]}", copy) for i in range(28)]
    recs += [(f"s{i:03}", "c", 100 + i, 600 + i + 1, None, t) for i, t in enumerate(around)]
    # No place at all; a shortened title, and a longer one; a number 100 off, as are the rows around it.
    rows = [("w-none", "e", None, None, copy), ("w-short", "e", None, "الباب ث", copy), ("w-long", "e", None, "تتمة كتاب الباب ج", copy), ("w-far", "e", 700, None, copy)]
    rows += [(f"x{i:03}", "e", 700 + i + 1, None, t) for i, t in enumerate(around)]
    got = K.link(spark.createDataFrame(recs, R_SCHEMA), spark.createDataFrame(rows, W_SCHEMA))
    want = {("r000", "w-none"), ("r003", "w-short"), ("r004", "w-long"), ("r010", "w-far")} | {(f"s{i:03}", f"x{i:03}") for i in range(12)}
    assert {(x["record_id"], x["witness_id"]) for x in got.collect()} == want


@pytest.mark.parametrize("crowd, cell", [(100_000, 2048), (20, 8)])
def test_linkage_over_a_run_that_all_texts_share(spark, monkeypatch, crowd, cell):
    """No place, and no run in common but the opening, which leads to more than BOUND pairs."""
    monkeypatch.setattr(K, "BOUND", 16)
    monkeypatch.setattr(K, "CROWD", crowd)
    monkeypatch.setattr(K, "CELL", cell)
    _, vocab, texts = world()
    tails = [vocab[i * 12 : i * 12 + 12] for i in range(30)]
    recs = [(f"r{i:03}", "c", i, None, None, " ".join(texts[0][:14] + t)) for i, t in enumerate(tails)]
    rows = [(f"w{i:03}", "e", None, None, " ".join(texts[0][:14] + [x if k % 3 else f"{x}ق{x}" for k, x in enumerate(t)])) for i, t in enumerate(tails)]
    got = K.link(spark.createDataFrame(recs, R_SCHEMA), spark.createDataFrame(rows, W_SCHEMA))
    assert {(x["record_id"], x["witness_id"]) for x in got.collect()} == {(f"r{i:03}", f"w{i:03}") for i in range(30)}


def test_linkage_empty(spark):
    r, w = spark.createDataFrame([], R_SCHEMA), spark.createDataFrame([], W_SCHEMA)
    assert K.link(r, w).count() == 0


# The queries -----------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_llm_query(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    got = sorted(tuple(str(v) for v in r) for r in df.collect())
    if sql := registry.ORACLE.get(name):
        con = duckdb.connect()
        for t in ("surface", "bindings", "documents", "mix_targets"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        rel = con.sql(sql)
        at = [rel.columns.index(c) for c in df.columns]
        assert got == sorted(tuple(str(r[i]) for i in at) for r in rel.fetchall())


def test_nothing_else_imports_this():
    import pathlib

    import wordloom

    root = pathlib.Path(wordloom.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "wordloom.llm" not in p.read_text("utf-8"), p
    assert pa
    assert D1 < D2
