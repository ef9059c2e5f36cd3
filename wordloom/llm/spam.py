"""Problem 8: keyword-stuffed pages and link lists, by the perplexity of word-class sequences.

A page is read as a sequence of classes: function word, content word, content word that the page keeps repeating, echo
(the refrain or rhyme that ends its lines), link, tag, number, and the marks between. Which words are function words is
induced from the corpus: the head of a language's words that takes up a good part of its running text and stands in
many of its pages. A trigram model of the classes is trained on the corpus's own prose, which is every page with enough
function words, and fitted again without the pages that it finds abnormal, until spam that reads like prose has lost its
say in it. Prose, chains, verse, litanies, glossaries and indexes are made of transitions that prose has; lists of
links, tags, search words and product phrases are not, and strings of one class are far too easy. Every window of a page
is scored; windows whose perplexity lies outside the band of the training pages' windows are abnormal, high or low, and
a page is spam when most of its words lie in abnormal windows, so that sentences put around a list do not hide it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.session import materialise, table

CLASSES = "FCKEULTNPMSVBDQ^"
# F function word, C content word, K content word that the page repeats, E echo, U link, L link at the end of a text of
# its own, T tag, N number, P sentence mark, M comma, S list mark, V verse divider, B line end, D colon, Q dots before a
# page number, ^ start.

#: A language's function words make up this part of its running text, and each stands in this part of its pages.
HEAD, SPREAD = 0.3, 0.4
#: A language tag counts as a language when it has this part of the pages; so there are few enough to keep their heads.
LANGUAGE = 0.01
#: A content word is one the page repeats from so many times on, and when it is this part of its content words.
TIMES, OFTEN = 4, 1 / 20
#: A link after so many words of its line is cited by them; after fewer they are only its title.
CITED = 7

_UNSEEN = regex.compile(r"[\p{Cf}\p{Mn}ـ]+")
_TOKEN = regex.compile(
    r"(?P<W>(?!https?://|www\.)[\p{L}_]+)|(?P<U><a\s[^>]*>.*?</a>|\[[^\[\]\n]*+\]\((?:https?://|www\.)[^)\s]*\)|(?:https?://|www\.)[^\s<>\])]+)"
    r"|(?P<T>#[\p{L}\p{N}_]+)|(?P<N>\p{N}+)|(?P<Q>\.{3,}|…)|(?P<P>[.!?؟؛;۔]+)|(?P<M>[,،]+)|(?P<D>:+)|(?P<B>\s*[\r\n]\s*)|(?P<V>\*{2,})|(?P<S>[|/•·»›–—-]+)",
    regex.IGNORECASE | regex.DOTALL,
)
# Fixed value: letters that languages of one script write differently, folded for counting.
_FOLD = str.maketrans("يكةى", "یکهی")

#: Tokens a window has, and the step to the next.
WINDOW, STEP = 16, 8

_SPLIT = regex.compile(regex.sub(r"\(\?P<\w>", "(?:", _TOKEN.pattern), _TOKEN.flags)


class _Tokens:
    """The tokens that a worker has met, numbered from 1, with each one's kind, word and number of words: pages share most
    of their tokens, and a batch of numbers is read by arrays."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.kind, self.word, self.size = [0], [0], [0]
        self.words: dict[str, int] = {"": 0}

    def add(self, token: str) -> int:
        kind = _TOKEN.fullmatch(token).lastgroup
        self.kind.append(ord(kind))
        self.word.append(self.words.setdefault(token.lower().translate(_FOLD), len(self.words)) if kind == "W" else 0)
        self.size.append(0 if kind in "PMSVBDQ" else max(1, len(token.split()) - 1) if kind == "U" else 1)
        self.ids[token] = at = len(self.kind) - 1
        return at


_MET = _Tokens()


def read_batch(texts: list[str | None]) -> dict[str, pa.Array]:
    """Of each text its kinds (a letter a token), the code of each token's word (-1: none), the distinct words by code with
    their times, and how many words each token stands for (a linked title has several)."""
    global _MET
    if len(_MET.kind) > 300_000:
        _MET = _Tokens()
    get, add = _MET.ids.get, _MET.add
    pages = [[get(t) or add(t) for t in _SPLIT.findall(_UNSEEN.sub("", text))] if text else [] for text in texts]
    n = np.array([len(p) for p in pages], "int64")
    flat = np.array([t for p in pages for t in p], "int64")
    page, ends = np.repeat(np.arange(len(n)), n), np.r_[0, np.cumsum(n)]
    kinds, word = np.array(_MET.kind, "uint8")[flat], np.array(_MET.word, "int64")[flat]
    has = word > 0
    many = len(_MET.words)
    keys, code, times = np.unique(page[has] * many + word[has], return_inverse=True, return_counts=True)
    per = np.bincount(keys // many, minlength=len(n))
    first = np.cumsum(per) - per
    codes = np.full(len(flat), -1, "<i4")
    codes[has] = code - first[page[has]]
    lists = pa.array(np.r_[0, np.cumsum(per)], pa.int32())
    binary = lambda x: pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((ends * 4).astype("<i4")), pa.py_buffer(x.astype("<i4"))])
    return {
        "kinds": pa.Array.from_buffers(pa.string(), len(n), [None, pa.py_buffer(ends.astype("<i4")), pa.py_buffer(kinds)]),
        "codes": binary(codes),
        "words": pa.ListArray.from_arrays(lists, pa.array(list(_MET.words), pa.string()).take(pa.array(keys % many))),
        "times": pa.ListArray.from_arrays(lists, pa.array(times, pa.int32())),
        "weight": binary(np.array(_MET.size, "int64")[flat]),
    }


def _echo(lines: list[list[int]], function: list[bool]) -> list[int]:
    """How many words at the end of each line are its refrain or rhyme; 0 where lines share no ending.

    Lines share an ending when at least three and a quarter of them close alike and those that go before it say
    something of their own: most of the words in front of it occur once.
    """
    ends = Counter(ln[-1] for ln in lines if ln)
    out = [0] * len(lines)
    for word, n in ends.most_common():
        if n < 3 or n < 0.25 * len(lines):
            break
        at = [i for i, ln in enumerate(lines) if ln and ln[-1] == word]
        size = 1
        while True:
            longer = Counter(tuple(lines[i][-size - 1 :]) for i in at if len(lines[i]) > size)
            if not longer or longer.most_common(1)[0][1] < 0.8 * len(at):
                break
            size += 1
        front = [lines[i][:-size] for i in at]
        own = Counter(w for f in front for w in f if not function[w])
        told = sum(1 for f in front if len(f) >= 2)
        if told < 3 or told < 0.3 * len(at) or sum(1 for c in own.values() if c == 1) < 0.5 * sum(own.values()):
            continue
        for i in at:
            out[i] = max(out[i], size)
    return out


def class_batch(kinds: list[str], codes: list[bytes], words: pa.ListArray, function: pa.Array) -> list[str]:
    """The pages' classes, one letter a token."""
    n = np.array([len(k) for k in kinds], "int64")
    ends, page = np.r_[0, np.cumsum(n)], np.repeat(np.arange(len(n)), n)
    kind = np.frombuffer("".join(kinds).encode("ascii"), "uint8")
    is_word, is_break, is_link = kind == ord("W"), kind == ord("B"), kind == ord("U")
    per = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    own = pc.is_in(words.flatten(), function).to_numpy(zero_copy_only=False)
    first = np.cumsum(per) - per
    code = np.frombuffer(b"".join(codes), "<i4").astype("int64")
    at = np.flatnonzero(is_word)
    word = code[at] + first[page[at]]  # the place of each word token's word among all pages' words

    echo = np.zeros(len(kind), bool)
    line = np.cumsum(is_break) + page
    last = np.flatnonzero(np.r_[line[at][1:] != line[at][:-1], True]) if len(at) else at
    close, closes = np.unique(word[last], return_counts=True)
    lines = np.bincount(page[is_break], minlength=len(n)) + 1
    whose = np.searchsorted(first + per, close, side="right")
    for k in np.unique(whose[(closes >= 3) & (closes >= 0.25 * lines[whose])]).tolist():
        inside = at[np.searchsorted(at, ends[k]) : np.searchsorted(at, ends[k + 1])]
        cut = np.searchsorted(line[inside], np.arange(line[ends[k]], line[ends[k]] + lines[k] + 1))
        rows = [inside[a:b] for a, b in zip(cut[:-1], cut[1:])]
        function_ = own[first[k] : first[k] + per[k]].tolist()
        for row, size in zip(rows, _echo([code[r].tolist() for r in rows], function_)):
            echo[row[len(row) - size :] if size else []] = True

    content = ~own[word] & ~echo[at]
    times = np.bincount(word[content], minlength=len(own))
    least = np.maximum(TIMES, OFTEN * np.bincount(page[at][content], minlength=len(n)))
    out = kind.copy()
    out[at] = np.where(echo[at], ord("E"), np.where(own[word], ord("F"), np.where(times[word] >= least[page[at]], ord("K"), ord("C"))))
    # Words since the last link or line end, at each link.
    upto = np.cumsum(is_word)
    mark = np.zeros(len(kind) + 1, "int64")
    mark[1:][is_break | is_link] = upto[is_break | is_link]
    starts = ends[:-1][n > 0]
    mark[starts] = np.maximum(mark[starts], (upto - is_word)[starts])
    said = upto - is_word - np.maximum.accumulate(mark)[:-1]
    out[is_link & (said >= CITED)] = ord("L")
    text = out.tobytes().decode("ascii")
    return [text[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def is_prose(cls: str) -> bool:
    """Pages that the model learns from: enough words, and function words among them or page numbers behind them."""
    n = sum(cls.count(c) for c in "FCKE")
    return n >= 20 and (cls.count("F") >= 0.1 * n or cls.count("N") >= 0.3 * n)


_CODE = np.zeros(256, "int64")
_CODE[[ord(c) for c in CLASSES]] = range(len(CLASSES))
_N = len(CLASSES)


def gram_name(number: int) -> str:
    return CLASSES[number // _N // _N] + CLASSES[number // _N % _N] + CLASSES[number % _N]


#: Weights of the trigram, bigram, unigram and even distributions. The last keeps one odd token at 9 bits: a
#: single link in a window does not make it abnormal, a list of them does.
MIX = (0.7, 0.2, 0.07, 0.03)
#: A transition that this part of the training pages has counts half, one that fewer have less.
SHARED = 1 / 2000


def log_probabilities(counts: np.ndarray, shared: np.ndarray | None = None, pages: float = 0) -> np.ndarray:
    """log2 probability of each trigram's last class, of counts of trigrams interpolated with shorter ones.

    shared: how many of the `pages` have each trigram, and behind those each bigram. What a trigram or bigram loses for
    being on few pages goes to the shorter one, so that a context seen on a few pages only says as little as one never seen.
    """
    tri = counts.reshape(_N, _N, _N).astype(float)
    bi = tri.sum(0)
    uni = bi.sum(0) / max(1.0, bi.sum())
    of3, of2 = tri.sum(2, keepdims=True), bi.sum(1, keepdims=True)
    if shared is not None and pages:
        trust = shared / (shared + SHARED * pages)
        tri, bi = tri * trust[: _N**3].reshape(tri.shape), bi * trust[_N**3 :].reshape(bi.shape)
    two = np.where(of2 > 0, (bi + (of2 - bi.sum(1, keepdims=True)) * uni[None, :]) / np.maximum(of2, 1), uni[None, :])
    three = np.where(of3 > 0, (tri + (of3 - tri.sum(2, keepdims=True)) * two[None, :, :]) / np.maximum(of3, 1), two[None, :, :])
    return np.log2(MIX[0] * three + MIX[1] * two[None] + MIX[2] * uni[None, None] + MIX[3] / _N).ravel()


_HEAD = regex.compile("B[CFK]{1,2}D")
LAYOUTS = ("text", "verse", "contents", "index", "glossary")


def layout(cls: str) -> str:
    """The page's layout by its marks: verse, contents, index, glossary or running text. Each has its own model, so
    that the rare layouts are not measured by running text."""
    n = max(1, len(cls))
    for name, mark, rate in (("verse", "V", 0.03), ("contents", "Q", 0.02), ("index", "N", 0.12)):
        if cls.count(mark) >= rate * n:
            return name
    heads = len(_HEAD.findall("B" + cls))
    return "glossary" if heads >= 3 and heads >= 0.5 * cls.count("B") else "text"


class Pages:
    """A batch of pages laid end to end: every step is one operation over all their tokens."""

    def __init__(self, cls: list[str], lay: list[str]) -> None:
        self.n = np.array([len(c) for c in cls], "int64")
        self.at = np.cumsum(self.n) - self.n
        self.page = np.repeat(np.arange(len(cls)), self.n)
        code = _CODE[np.frombuffer("".join("^^" + c for c in cls).encode("ascii"), "uint8")]
        here = np.arange(self.n.sum()) + 2 * (self.page + 1)  # each page has two starts before it
        self.grams = (code[here - 2] * _N + code[here - 1]) * _N + code[here]
        self.lay = np.array([LAYOUTS.index(x) for x in lay], "int64")

    def surprise(self, models: np.ndarray) -> np.ndarray:
        """-log2 probability of each token under its page's model; models: a row a layout."""
        return -models[self.lay[self.page], self.grams] if len(self.page) else np.zeros(0)

    def windows(self, lp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """page, start, end and mean surprise (log2 perplexity) of every window; a short page is one, an empty page none."""
        whole = np.where(self.n > 0, np.maximum(0, self.n - WINDOW) // STEP + 1, 0)
        tail = ((self.n > WINDOW) & ((self.n - WINDOW) % STEP > 0)).astype("int64")
        k = whole + tail
        page = np.repeat(np.arange(len(k)), k)
        nth = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        start = np.minimum(nth * STEP, np.maximum(0, self.n[page] - WINDOW)) + self.at[page]
        end = np.minimum(start + WINDOW, self.at[page] + self.n[page])
        total = np.r_[0.0, np.cumsum(lp)]
        return page, start, end, (total[end] - total[start]) / np.maximum(1, end - start)

    def abnormal(self, models: np.ndarray, bands: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each page the share of its words that lie in windows outside its layout's band, and its mean surprise."""
        lp = self.surprise(models)
        page, start, end, score = self.windows(lp)
        # The mean of fewer tokens than a window's spreads wider, by the root of their number.
        wide = np.sqrt(WINDOW / np.maximum(1, end - start))
        middle, half = bands[self.lay[page]].mean(1), (bands[self.lay[page], 1] - bands[self.lay[page], 0]) / 2 * wide
        low, high = middle - half, middle + half
        odd = ((score > high) | (score < low)).astype(float)
        size = len(lp) + 1
        seen = np.cumsum(np.bincount(start, minlength=size) - np.bincount(end, minlength=size))[:-1]
        votes = np.cumsum(np.bincount(start, odd, size) - np.bincount(end, odd, size))[:-1]
        bad = votes * 2 >= np.maximum(seen, 1) - 1e-9
        sums = lambda v: np.bincount(self.page, v, len(self.n))
        return sums(weight * bad) / np.maximum(1.0, sums(weight)), sums(lp) / np.maximum(1, self.n)


#: Width of the bins in which the training windows' surprise is counted, and their number.
BIN, BINS = 0.02, 800
#: A window is abnormal this many robust standard deviations from its layout's median.
DEVIATIONS = 3.5
#: A page is spam when this share of its words lies in abnormal windows; one with more than DOUBT of them abnormal is left
#: out when the model is fitted again, which is done FITS times in all.
MAJORITY, DOUBT, FITS = 0.5, 0.25, 3


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, lang, text to id, lang, kinds, codes, words, times, weight."""
    for batch in batches:
        got = read_batch(batch.column(2).to_pylist())
        yield pa.record_batch([batch.column(0), batch.column(1), *got.values()], names=["id", "lang", *got])


def function_words(pages: DataFrame) -> DataFrame:
    """word: of each language (a tag in lower case; those without one are a language too) the most frequent words that
    make up HEAD of its running text together, as far as each stands in SPREAD of its pages.

    Counts combine before their shuffle; the window runs over the words that stand in SPREAD of a language's pages,
    of which there are at most 1 / SPREAD times the words of a page.
    """
    n = pages.agg(F.count(F.lit(1)).alias("n")).scalar()
    tag = F.lower(F.coalesce("lang", F.lit("")))
    text = F.sum(F.aggregate("times", F.lit(0).cast("bigint"), lambda a, x: a + x))
    sizes = pages.groupBy(tag.alias("tag")).agg(F.count(F.lit(1)).alias("pages"), text.alias("all_tf")).where(F.col("pages") >= LANGUAGE * n)
    per = pages.select(tag.alias("tag"), F.inline(F.arrays_zip("words", "times"))).groupBy("tag", "words").agg(F.count(F.lit(1)).alias("df"), F.sum("times").alias("tf"))
    often = per.join(F.broadcast(sizes), "tag").where(F.col("df") >= SPREAD * F.col("pages"))
    upto = F.sum("tf").over(Window.partitionBy("tag").orderBy(F.col("tf").desc(), "words").rowsBetween(Window.unboundedPreceding, 0))
    return often.withColumn("upto", upto).where(F.col("upto") <= HEAD * F.col("all_tf")).select(F.col("words").alias("word")).distinct()


def _classify(function: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(function, pa.string())
        for batch in batches:
            cls = class_batch(batch.column("kinds").to_pylist(), batch.column("codes").to_pylist(), batch.column("words"), known)
            yield pa.record_batch(
                [batch.column("id"), pa.array(cls, pa.string()), batch.column("weight"), pa.array(list(map(layout, cls)), pa.string()), pa.array(list(map(is_prose, cls)), pa.bool_())],
                names=["id", "cls", "weight", "layout", "prose"],
            )

    return run


def _pages(batch: pa.RecordBatch) -> tuple[Pages, np.ndarray]:
    weight = b"".join(batch.column("weight").to_pylist())
    return Pages(batch.column("cls").to_pylist(), batch.column("layout").to_pylist()), np.frombuffer(weight, "<i4").astype(float)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """layout, gram, n: how often each trigram occurs; from _N**3 on how many pages have it, then how many have each
    bigram, and last the number of pages."""
    whole = _N**3
    total = np.zeros((len(LAYOUTS), 2 * whole + _N**2 + 1), "int64")
    for batch in batches:
        p, _ = _pages(batch)
        np.add.at(total, (p.lay[p.page], p.grams), 1)
        for size, start in ((whole, whole), (_N**2, 2 * whole)):
            own = np.unique(p.page * size + p.grams % size)
            np.add.at(total, (p.lay[own // size], start + own % size), 1)
        np.add.at(total, (p.lay[p.n > 0], -1), 1)
    lay, at = np.nonzero(total)
    yield pa.record_batch([pa.array(lay.astype("int32")), pa.array(at.astype("int32")), pa.array(total[lay, at])], names=["layout", "gram", "n"])


def _histogram(models: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(LAYOUTS), BINS), "int64")
        for batch in batches:
            p, _ = _pages(batch)
            page, _, _, score = p.windows(p.surprise(models))
            np.add.at(total, (p.lay[page], np.minimum(score / BIN, BINS - 1).astype("int64")), 1)
        lay, at = np.nonzero(total)
        yield pa.record_batch([pa.array(lay.astype("int32")), pa.array(at.astype("int32")), pa.array(total[lay, at])], names=["layout", "bin", "n"])

    return run


def _keep(models: np.ndarray, bands: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, weight = _pages(batch)
            yield batch.filter(pa.array(p.abnormal(models, bands, weight)[0] <= DOUBT))

    return run


def _score(models: np.ndarray, bands: np.ndarray, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, weight = _pages(batch)
            share, surprise = p.abnormal(models, bands, weight)
            yield pa.record_batch([batch.column("id").cast(id_type), pa.array(share), pa.array(surprise)], names=["id", "abnormal_share", "surprise"])

    return run


def _fit(prose: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The models (a row a layout) and their bands (low, high). A layout that no prose has is read by the model of
    running text; without any prose nothing is abnormal."""
    counts = np.zeros((len(LAYOUTS), 2 * _N**3 + _N**2 + 1))
    for r in prose.mapInArrow(_count, "layout int, gram int, n bigint").groupBy("layout", "gram").agg(F.sum("n").alias("n")).collect():
        counts[r["layout"], r["gram"]] = r["n"]
    counts = [c if c.any() else counts[0] for c in counts]
    models = np.array([log_probabilities(c[: _N**3], c[_N**3 : -1], c[-1]) for c in counts])
    bins = np.zeros((len(LAYOUTS), BINS))
    for r in prose.mapInArrow(_histogram(models), "layout int, bin int, n bigint").groupBy("layout", "bin").agg(F.sum("n").alias("n")).collect():
        bins[r["layout"], r["bin"]] = r["n"]
    bands = np.tile([-1e9, 1e9], (len(LAYOUTS), 1))
    for k, h in enumerate(bins):
        h = h if h.any() else bins[0]
        if h.any():
            q1, q2, q3 = (float(np.searchsorted(np.cumsum(h), q * h.sum()) + 0.5) * BIN for q in (0.25, 0.5, 0.75))
            sd = max((q3 - q1) / 1.349, 0.2)
            bands[k] = (q2 - DEVIATIONS * sd, q2 + DEVIATIONS * sd)
    return models, bands


def page_scores(df: DataFrame, key: str, text: str, lang: str | None = None) -> DataFrame:
    """Columns id, abnormal_share, surprise, is_spam: one row for each row of df. lang: a column with a tag of the page's
    language, null or wrong for some; without one all pages are one language.

    Null, empty and wordless texts score 0 and are no spam; copies score alike. Function words, models and bands come
    from all pages of df: what reaches the driver is the list of function words (at most 1 / SPREAD times the words of a
    page for each of at most 1 / LANGUAGE languages), a table of class trigrams and their pages (16 classes, 5 layouts) and a histogram
    of fixed bins, whatever the size of df. Without prose to learn from nothing is spam.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    tag = F.col(lang).cast("string") if lang else F.lit(None).cast("string")
    src = df.select(F.col(key).alias("id"), tag.alias("lang"), F.col(text).cast("string").alias("text"))
    id_dt = src.schema["id"].dataType.simpleString()
    read = materialise(src.mapInArrow(_tokenise, f"id {id_dt}, lang string, kinds string, codes binary, words array<string>, times array<int>, weight binary"), "spam-tokens")
    function = sorted(r["word"] for r in function_words(read).collect())
    pages = materialise(read.select("id", "kinds", "codes", "words", "weight").mapInArrow(_classify(function), f"id {id_dt}, cls string, weight binary, layout string, prose boolean"), "spam-classes")
    prose = pages.where("prose").select("cls", "weight", "layout")
    models, bands = _fit(prose)
    for _ in range(FITS - 1):
        models, bands = _fit(materialise(prose.mapInArrow(_keep(models, bands), "cls string, weight binary, layout string"), "spam-prose"))
    out = pages.select("id", "cls", "weight", "layout").mapInArrow(_score(models, bands, to_arrow_type(src.schema["id"].dataType)), f"id {id_dt}, abnormal_share double, surprise double")
    return out.withColumn("is_spam", F.col("abnormal_share") > MAJORITY)


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, abnormal_share, surprise, is_spam of every document."""
    return page_scores(table(spark, sf_dir, "documents"), "doc_id", "text", "lang").withColumnRenamed("id", "doc_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are spam."""
    return p8_scores(spark, sf_dir).where("is_spam").select("doc_id")


QUERIES = {"p8_found": p8_found, "p8_scores": p8_scores}
ORACLE: dict[str, str] = {}
