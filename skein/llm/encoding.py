"""Encoding of a corpus with a public tokenizer, long texts in parallel chunks."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.session import read, stage

#: Rank file of the tokenizer (base64 token and rank per line) on every executor; a parameter.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern by which the rank files' texts are split before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a chunk, and how far it reaches into the next one. Most articles have several chunks.
CHUNK, OVERLAP = 1 << 10, 1 << 6
#: A text of more characters than this has its chunks, then of this size, spread over all tasks.
SPREAD, SPREAD_OVERLAP = 1 << 16, 1 << 11
#: A pre-token that ends at least so many characters before a chunk's end doesn't depend on what follows.
SETTLED = 4


@lru_cache(maxsize=4)
def _encoder(ranks: str):
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


@lru_cache(maxsize=1)
def _splitter():
    import regex

    return regex.compile(PATTERN)


class _Ids(dict):
    """Pre-token -> its ids, as the bytes of int32; emptied when large, so a worker's memory is bounded."""

    def __init__(self, ranks: str):
        self.encode = _encoder(ranks).encode_ordinary

    def __missing__(self, token: str) -> bytes:
        ids = np.array(self.encode(token), np.int32).tobytes()
        if len(token) <= 64:
            if len(self) > 500_000:
                self.clear()
            self[token] = ids
        return ids


_ids = lru_cache(maxsize=4)(_Ids)


def stitched(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[list[str]]:
    """The pre-tokens of ``text``, a list for each piece.

    Chunks of ``chunk`` characters that reach ``overlap`` into the next are pre-tokenised alone.
    A chunk may begin within a pre-token, but from the first boundary on that it shares with
    its predecessor the two agree for good: there one piece ends and the next begins. A chunk
    that shares none with the next is joined with it and pre-tokenised again from its last
    boundary known to be right.
    """
    find, n = _splitter().findall, len(text)
    begin, at, stop = 0, 0, min(chunk, n)
    tokens = find(text[: stop + overlap])
    while stop < n:
        following = find(text[stop : stop + chunk + overlap])
        heads, p, sure = {}, stop, min(stop + overlap, n) - SETTLED
        for i, t in enumerate(following):
            if p > sure:
                break
            heads[p] = i
            p += len(t)
        met, p, j = None, min(stop + overlap, n), len(tokens)
        while j > at and p - len(tokens[j - 1]) >= stop:
            j -= 1
            p -= len(tokens[j])
            if p in heads:
                met = j, heads[p]
        if met:
            yield tokens[at : met[0]]
            tokens, at, begin, stop = following, met[1], stop, min(stop + chunk, n)
        else:  # each time twice as far, so that a long pre-token isn't read again and again
            begin += sum(map(len, tokens[:at]))
            stop = min(stop + max(chunk, stop - begin), n)
            tokens, at = find(text[begin : stop + overlap]), 0
    yield tokens[at:]


def _pieces(texts: list[str], ranks: str) -> pa.Array:
    encode = _encoder(ranks).encode_ordinary
    return pa.array([encode(t) for t in texts], pa.list_(pa.int32()))


def _encode_or_cut(batches: Iterator[pa.RecordBatch], ranks: str, chunk: int, overlap: int, spread: int, reach: int) -> Iterator[pa.RecordBatch]:
    """(key, text) to (key, ids) of a text of up to ``spread`` characters, to (key, k, n, text) of each chunk of a longer one."""
    ids = _ids(ranks)

    def batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        coded = [r[1] for r in rows]
        ends = np.cumsum([0, *(len(c) // 4 if c is not None else 0 for c in coded)], dtype=np.int32)
        values = pa.array(np.frombuffer(b"".join(c for c in coded if c is not None), np.int32))
        lists = pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array([c is None for c in coded], pa.bool_()))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), lists, *(pa.array([r[i] for r in rows], t) for i, t in ((2, pa.int64()), (3, pa.int64()), (4, pa.string())))], ["key", "ids", "k", "n", "text"])

    for b in batches:
        rows, size = [], 0
        for key, text in zip(b.column(0), b.column(1), strict=True):
            key, text = key.as_py(), text.as_py() or ""
            n = -(-len(text) // spread)
            if n <= 1:
                rows.append((key, b"".join(map(ids.__getitem__, chain.from_iterable(stitched(text, chunk, overlap)))), None, None, None))
            for k in range(n if n > 1 else 0):
                rows.append((key, None, k, n, text[k * spread : (k + 1) * spread + reach]))
                size += spread
                if size > 1 << 24:
                    yield batch(rows, b.schema.types[0])
                    rows, size = [], 0
        yield batch(rows, b.schema.types[0])


def _bounds(text: str, chunk: int, overlap: int, first: bool, last: bool) -> tuple[list[int], list[int]]:
    """Pre-token starts of a chunk: within its first ``overlap`` characters, and those past ``chunk``, from there on.

    Of the latter, those after a blank don't count: blanks at the end of a piece would be split
    otherwise than before a word.
    """
    head, tail = [], []
    for m in _splitter().finditer(text):
        at = m.start()
        if not first and at < overlap - SETTLED:
            head.append(at)
        if not last and chunk <= at <= len(text) - SETTLED and not text[at - 1].isspace():
            tail.append(at - chunk)
    return head, tail


def _split(batches: Iterator[pa.RecordBatch], chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        k, n = b.column("k").to_pylist(), b.column("n").to_pylist()
        found = [_bounds(t, chunk, overlap, i == 0, i == m - 1) for t, i, m in zip(b.column("text").to_pylist(), k, n, strict=True)]
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([h for h, _ in found], kind), pa.array([t for _, t in found], kind)], [*b.schema.names, "head", "tail"])


def _join_and_encode(batches: Iterator[pa.RecordBatch], ranks: str, chunk: int) -> Iterator[pa.RecordBatch]:
    """(id, run, start, stop, parts) to (id, run, ids): a run's text from its first sync point to its last, encoded.

    ``ids`` is null where ``stop`` turns out to be no boundary of the joined text.
    """
    for b in batches:
        rows = []
        for start, stop, parts in zip(b.column("start").to_pylist(), b.column("stop").to_pylist(), b.column("parts").to_pylist(), strict=True):
            parts.sort(key=lambda p: p["k"])
            text = "".join(p["text"][:chunk] for p in parts[:-1]) + parts[-1]["text"]
            stop = len(text) if stop is None else stop + (len(parts) - 1) * chunk
            sure = len(parts) == 1 or stop == len(text) or any(m.start() == stop for m in _splitter().finditer(text, start))
            rows.append(_encoder(ranks).encode_ordinary(text[start:stop]) if sure else None)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column("run"), pa.array(rows, pa.list_(pa.int32()))], [b.schema.names[0], "run", "ids"])


def encode(docs: DataFrame, key: str, text: str, ranks: str = RANKS, chunk: int = CHUNK, overlap: int = OVERLAP, spread: int = SPREAD, reach: int = SPREAD_OVERLAP) -> DataFrame:
    """``key`` and ``ids`` (array of int): each text by the tokenizer of ``ranks``, without special tokens.

    A null and an empty text give an empty list. Strings of special tokens are ordinary text.
    ``key`` should be unique and not null; other columns are ignored.

    Every text is cut into overlapping chunks that are pre-tokenised alone, stitched where their
    boundaries meet (:func:`stitched`), and encoded piece by piece, where it is read: the texts
    of a corpus are read by all tasks, so nothing moves. Only a text beyond ``spread`` characters
    would hold up its task; its chunks, then of ``spread`` characters, go to all tasks in the
    same way, and the pieces are put together in order. Where neighbours share no boundary (a
    pre-token longer than the overlap), they are joined and split again as one; if even then the
    end is no boundary, the document is encoded as a whole. One pass over the texts gives the
    finished ids and the chunks of the longest together; it is written once.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    coded = rows.mapInArrow(lambda it: _encode_or_cut(it, ranks, chunk, overlap, spread, reach), f"key {kind}, ids array<int>, k bigint, n bigint, text string")
    coded = stage(coded, "encode-ids")
    out, cut = coded.where("k IS NULL").select("key", "ids"), coded.where("k IS NOT NULL").select("key", "k", "n", "text")
    if not cut.isEmpty():
        out = out.unionByName(_encode_long(cut, kind, ranks, spread, reach))
    return out.select(F.col("key").alias(key), "ids")


def _encode_long(cut: DataFrame, kind: str, ranks: str, chunk: int, overlap: int) -> DataFrame:
    """(key, ids) from the chunks (key, k, n, text) of long texts, staged."""
    split = cut.repartition("key", "k").mapInArrow(lambda it: _split(it, chunk, overlap), f"key {kind}, k bigint, n bigint, text string, head array<bigint>, tail array<bigint>")
    split = stage(split, "encode-chunks")
    ends = split.select("key", "k", "n", "tail")
    heads = split.select("key", (F.col("k") - 1).alias("k"), "head")
    marks = ends.join(heads, ["key", "k"], "left").select("key", "k", "n", F.array_min(F.array_intersect("tail", "head")).alias("sync"))
    # Chunks of a document without text: a few numbers for every 64 K characters.
    order = Window.partitionBy("key").orderBy("k")
    before = F.lag("sync").over(order)
    runs = marks.withColumn("before", before).withColumn("run", F.count("sync").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    parts = runs.join(split.select("key", "k", "text"), ["key", "k"])
    parts = parts.groupBy("key", "run").agg(
        F.coalesce(F.min_by("before", "k"), F.lit(0)).alias("start"),
        F.max_by(F.when(F.col("sync").isNotNull(), F.col("sync") + chunk), "k").alias("stop"),
        F.collect_list(F.struct("k", "text")).alias("parts"),
    )
    coded = stage(parts.mapInArrow(lambda it: _join_and_encode(it, ranks, chunk), f"key {kind}, run bigint, ids array<int>"), "encode-pieces")
    lost = coded.where("ids IS NULL").select("key").distinct()
    sure = coded.join(lost, "key", "left_anti").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("run", "ids"))).alias("_p"))
    sure = sure.select("key", F.flatten(F.col("_p.ids")).alias("ids"))

    def as_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _pieces(b.column(1).to_pylist(), ranks)], ["key", "ids"])

    whole = split.join(lost, "key", "left_semi").select("key", "k", F.when(F.col("k") < F.col("n") - 1, F.substring("text", 1, chunk)).otherwise(F.col("text")).alias("text"))
    whole = whole.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("k", "text"))).alias("_p")).select("key", F.array_join("_p.text", "").alias("text"))
    return sure.unionByName(whole.mapInArrow(as_whole, f"key {kind}, ids array<int>"))


def decode(encoded: DataFrame, key: str, ids: str = "ids", ranks: str = RANKS) -> DataFrame:
    """``key`` and ``text``: the bytes of the ids one after the other; a null list gives null.

    Bytes that are no UTF-8 (from ids that :func:`encode` didn't give) become U+FFFD.
    """
    rows = encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_bytes = _encoder(ranks).decode_bytes
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else to_bytes(x).decode("utf-8", "replace") for x in b.column(1).to_pylist()], pa.string())], ["key", "text"])

    return rows.mapInArrow(texts, f"key {rows.schema['key'].dataType.simpleString()}, text string").select(F.col("key").alias(key), "text")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the ids of its text by byte_bpe_50k."""
    return encode(read(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def p8_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and tokens of each source."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "source")
    n = p8_ids(spark, sf_dir).select("doc_id", F.size("ids").alias("n"))
    return docs.select("doc_id", "source").join(n, "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_tokens"), F.max("n").alias("longest"))


QUERIES = {"p8_ids": p8_ids, "p8_lengths": p8_lengths}
ORACLE: dict[str, str] = {}
