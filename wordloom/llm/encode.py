"""Problem 6: the whole corpus as token ids, by a global shuffle of distinct words.

Texts are split into pre-tokens with their positions. A block of texts keeps its positions as codes into the
list of its distinct words, so that a word leaves a block once however often it occurs. The words of all
blocks meet in one shuffle, each distinct word is encoded once, its ids are joined back to the blocks that
hold it, and every block puts its texts together again by position.

A word comes at most once a block, so a word that every text holds has one row a block: 1 / 4,000,000 of the
characters. Blocks are bounded in characters (one longer text is a block
of its own), so no task holds more than a block.
"""

from __future__ import annotations

import base64
import importlib.util
import itertools
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.session import materialise, table

#: Characters of text after which a block is closed.
BLOCK_CHARS = 4_000_000
#: Blocks that one task puts together, where there are so many that they even out (32 MB of text).
BLOCKS_A_TASK = 8
# Fixed value: the published pattern that splits text before the merges of the rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_dir() -> str:
    """The folder of the public tokenizers' files: WORDLOOM_TOKENIZERS, /opt/tokenizers or the installed package."""
    spec = importlib.util.find_spec("public_tokenizers")
    for place in (os.environ.get("WORDLOOM_TOKENIZERS"), "/opt/tokenizers", spec and os.path.dirname(spec.origin or "")):
        if place and os.path.isdir(place):
            return place
    raise FileNotFoundError("set WORDLOOM_TOKENIZERS to the folder of the tokenizers' files")


@dataclass(frozen=True)
class Vocab:
    """A public byte-level BPE vocabulary as ranks. Executors read the file at the same path."""

    path: str
    pattern: str = PATTERN

    @staticmethod
    def byte_bpe_50k(folder: str | None = None) -> Vocab:
        return Vocab(os.path.join(folder or tokenizer_dir(), "byte_bpe_50k.tiktoken"))


@lru_cache(maxsize=4)
def ranks(vocab: Vocab) -> dict[bytes, int]:
    with open(vocab.path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoder(vocab: Vocab):
    """text -> ids, no special tokens."""
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=vocab.pattern, mergeable_ranks=ranks(vocab), special_tokens={}).encode_ordinary


def _blocks(vocab: Vocab, block_chars: int, id_type: pa.DataType):
    """Batches (id, text) to one row a block: ids, pre-tokens per text, codes of all pre-tokens, the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split = regex.compile(vocab.pattern).findall
        # A block is named by its task's partition and its turn there, so a task run again names alike.
        task, turn = TaskContext.get(), itertools.count()
        words: dict[str, int] = {}
        codes: list[np.ndarray] = []
        ids, lens, chars = [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal words, codes, ids, lens, chars
            flat = np.concatenate(codes) if codes else np.zeros(0, "int32")
            if len(words) < 65536:
                flat = flat.astype("uint16")
            row = pa.record_batch(
                [
                    pa.array([f"{task.partitionId() if task else 0}-{next(turn)}"]),
                    pa.array([ids], pa.list_(id_type)),
                    pa.array([lens], pa.list_(pa.int32())),
                    pa.array([flat.tobytes()], pa.binary()),
                    pa.array([list(words)], pa.list_(pa.string())),
                ],
                names=["block", "ids", "lens", "codes", "words"],
            )
            words, codes, ids, lens, chars = {}, [], [], [], 0
            return row

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                cut = split(text) if text else []
                codes.append(np.fromiter([words.setdefault(w, len(words)) for w in cut], "int32", len(cut)))
                ids.append(key)
                lens.append(len(cut))
                chars += len(text or "")
                if chars >= block_chars:
                    yield close()
        if ids:
            yield close()

    return run


def _encode_words(vocab: Vocab):
    """Distinct words to their ids, as little-endian 32-bit integers in one binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocab)
        for batch in batches:
            words = batch.column(0)
            out = [np.array(encode(w), "<i4").tobytes() for w in words.to_pylist()]
            yield pa.record_batch([words, pa.array(out, pa.binary())], names=["word", "tokens"])

    return run


def _reassemble(id_type: pa.DataType, counts_only: bool):
    def run(block: pa.Table, words: pa.Table) -> pa.Table:
        out_ids, out = [], []
        words = words.sort_by("pos")
        chunks = words.column("tokens").chunks
        toks = pa.concat_arrays(chunks) if chunks else pa.array([], pa.binary())
        size = (pc.binary_length(toks).to_numpy(zero_copy_only=False) // 4).astype("int64")
        flat = np.frombuffer(b"".join(toks.to_pylist()), "<i4")
        start = np.cumsum(size) - size
        for k in range(block.num_rows):  # one row a block
            ids = block.column("ids")[k].values
            lens = block.column("lens")[k].values.to_numpy(zero_copy_only=False)
            raw = block.column("codes")[k].as_py()
            codes = np.frombuffer(raw, "uint16" if len(size) < 65536 else "int32").astype("int64")
            n = size[codes]
            ends = np.r_[0, np.cumsum(n)][np.r_[0, np.cumsum(lens)]]
            out_ids.append(ids.cast(id_type))
            if counts_only:
                out.append(pa.array(np.diff(ends), pa.int64()))
            else:
                at = np.repeat(start[codes] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[at], pa.int32())))
        name = "n_tokens" if counts_only else "ids"
        return pa.table({"id": pa.chunked_array(out_ids), name: pa.chunked_array(out)})

    return run


def _encode(df: DataFrame, key: str, text: str, vocab: Vocab, block_chars: int, counts_only: bool) -> DataFrame:
    src = df.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    id_dt = src.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(id_dt)
    shape = T.StructType(
        [
            T.StructField("block", T.StringType()),
            T.StructField("ids", T.ArrayType(id_dt)),
            T.StructField("lens", T.ArrayType(T.IntegerType())),
            T.StructField("codes", T.BinaryType()),
            T.StructField("words", T.ArrayType(T.StringType())),
        ]
    )
    # Written once: two branches read it, and a lost executor must not cut the blocks anew.
    blocks = materialise(src.mapInArrow(_blocks(vocab, block_chars, id_type), shape), "encode-blocks")
    held = blocks.select("block", F.posexplode("words").alias("pos", "word"))
    known = held.select("word").distinct().mapInArrow(_encode_words(vocab), "word string, tokens binary")
    back = held.join(known, "word").select(F.col("block").alias("home"), "pos", "tokens")
    result = T.StructType([T.StructField("id", id_dt), T.StructField("n_tokens", T.LongType()) if counts_only else T.StructField("ids", T.ArrayType(T.IntegerType()))])
    # Few blocks get twice their number of partitions, as a hash puts several into one by chance; many even out by
    # themselves. A task has some BLOCKS_A_TASK blocks at most, however many there are.
    n = blocks.count()
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(2 * n, 2_000 + n // BLOCKS_A_TASK))
    texts = blocks.select("block", "ids", "lens", "codes").repartition(parts, "block").groupBy("block")
    return texts.cogroup(back.repartition(parts, "home").groupBy("home")).applyInArrow(_reassemble(id_type, counts_only), result)


def encode_corpus(df: DataFrame, key: str, text: str, vocab: Vocab | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Columns id, ids: one row for every row of df, its text's token ids without special tokens.

    A null text and an empty one have an empty list; texts are taken as they are and whole. Keys may be null or
    repeat: each row is encoded for itself. An empty df gives no rows; other columns are never read.
    """
    return _encode(df, key, text, vocab or Vocab.byte_bpe_50k(), block_chars, counts_only=False)


def token_counts(df: DataFrame, key: str, text: str, vocab: Vocab | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Columns id, n_tokens: as encode_corpus, the numbers only; 0 for a null or empty text."""
    return _encode(df, key, text, vocab or Vocab.byte_bpe_50k(), block_chars, counts_only=True)


def decode_corpus(df: DataFrame, key: str, ids: str, vocab: Vocab | None = None) -> DataFrame:
    """Columns id, text: ids joined with the token-byte table (fixed size, read by each worker) and put together.

    An empty list is the empty text, a null list null. Bytes that are no UTF-8 (ids cut inside a letter) give
    U+FFFD; an id outside the table raises.
    """
    vocab = vocab or Vocab.byte_bpe_50k()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = [b""] * (max(ranks(vocab).values()) + 1)
        for raw, k in ranks(vocab).items():
            table_[k] = raw
        tokens = pa.array(table_, pa.binary())
        for batch in batches:
            lists = batch.column(1)
            took = tokens.take(pc.list_flatten(lists))
            sizes = pc.fill_null(pc.list_value_length(lists), 0)
            ends = np.r_[0, np.cumsum(sizes.to_numpy(zero_copy_only=False))]
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), took), pa.scalar(b"", pa.binary()))
            texts = [None if a is None else b.decode("utf-8", "replace") for a, b in zip(sizes_or_null(lists), joined.to_pylist())]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    def sizes_or_null(lists: pa.Array) -> list:
        return pc.list_value_length(lists).to_pylist()

    src = df.select(F.col(key).alias("id"), F.col(ids).alias("ids"))
    return src.mapInArrow(run, T.StructType([src.schema["id"], T.StructField("text", T.StringType())]))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and ids of every document under byte_bpe_50k."""
    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The round trip: every document's text from its ids, with whether it is the stored text (a null text
    comes back empty)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    back = decode_corpus(p6_ids(spark, sf_dir), "doc_id", "ids").select(F.col("id").alias("doc_id"), F.length("text").cast("bigint").alias("n_chars"), F.xxhash64("text").alias("g"))
    return docs.join(back, "doc_id").select("doc_id", "n_chars", (F.col("h") == F.col("g")).alias("exact"))


QUERIES = {"p6_ids": p6_ids, "p6_decoded": p6_decoded}
ORACLE: dict[str, str] = {"p6_decoded": "SELECT doc_id, CAST(coalesce(length(text), 0) AS BIGINT) AS n_chars, true AS exact FROM documents"}
