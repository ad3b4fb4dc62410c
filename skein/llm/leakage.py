"""Passages of evaluation items within training texts, found by spaced seeds."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.skew import skew_join
from skein.session import read, stage

#: Words of a seed's window, and its masks: the positions each one ignores. Together they ignore
#: every position once, so a window with any one word substituted still meets by one of them.
SPAN = 12
IGNORED = ((0, 4, 5, 9), (1, 3, 8, 10), (2, 6, 7, 11))
#: Seeds of one shard; each has a sieve of at most 32 MB (32 bits a seed) and its pass over the texts.
SHARD_SEEDS, SEED_BITS = 1 << 23, 32
#: Probes of a seed into the sieve: about 1 in 40,000 windows that match nothing passes.
PROBES = 6
#: Places of one seed that stand in one row.
PLACES = 1024
#: A line break, a markup command, or a word: a run of letters and digits.
_TOKENS = re.compile(r"\\\\|\\[A-Za-z]+|([^\W_]+)")


class _Hashes(dict):
    """Word -> 64-bit hash; emptied when large, so a worker's memory is bounded."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()
_MULT = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) | 1 for i in range(64)], dtype=np.uint64)


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words of ``text``; case, markup commands and what stands between don't count."""
    words = [w for w in _TOKENS.findall(text.lower()) if w] if text else []
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def seeds(words: np.ndarray, span: int = SPAN, ignored: tuple = IGNORED) -> np.ndarray:
    """One row for each mask: the seed hash of every window of ``span`` words."""
    n = len(words) - span + 1
    if n < 1:
        return np.empty((len(ignored), 0), np.uint64)
    out = np.zeros((len(ignored), n), np.uint64)
    for m, skip in enumerate(ignored):
        for i in range(span):
            if i not in skip:
                out[m] += words[i : i + n] * _MULT[i]
        out[m] ^= out[m] >> np.uint64(29)
        out[m] *= _MULT[20 + m]
        out[m] ^= out[m] >> np.uint64(32)
    return out


def _probes(h: np.ndarray, bits: int, probe: int) -> np.ndarray:
    """Which of 2^bits bits stand for the seeds ``h`` in one of the probes."""
    return ((h ^ (h >> np.uint64(31))) * _MULT[40 + probe]) >> np.uint64(64 - bits)


def _sieve_words(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """(hash) to (word, mask): the bits of the seeds, by words of 64."""
    for b in batches:
        h = b.column(0).to_numpy().view(np.uint64)
        at = np.unique(np.concatenate([_probes(h, bits, p) for p in range(PROBES)])) if len(h) else h
        word, first = np.unique(at >> np.uint64(6), return_index=True)
        masks = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
        yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(masks.view(np.int64))], ["word", "mask"])


def sieve(hashes: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of ``n`` seeds: made by all tasks and merged by words, so at most 32 MB reach the driver."""
    bits = max(10, (max(n, 1) * SEED_BITS - 1).bit_length())
    words = hashes.mapInArrow(lambda it: _sieve_words(it, bits), "word bigint, mask bigint").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy().view(np.uint64)
    return out


def sifted(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Positions of the hashes ``h`` that pass the sieve: all that are in it and few others."""
    bits, at = len(known).bit_length() + 5, np.arange(len(h))
    for p in range(PROBES):
        place = _probes(h[at] if p else h, bits, p)
        at = at[(known[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)]
    return at


def _segments(batches: Iterator[pa.RecordBatch], known, around: int) -> Iterator[pa.RecordBatch]:
    """(key, text) to stretches of words with seed hits: (key, first, words, at, hash).

    ``first`` is the position of the stretch in the text, ``at`` and ``hash`` its hits. Hits
    nearer than 2 * ``around`` words share a stretch, which has ``around`` words on both sides.
    """
    for b in batches:
        keys, rows = [], []
        texts = b.column(1).to_pylist()
        for begin, words, ends in _in_parts(texts):
            # The seeds of several texts at once; windows that reach into the next text don't count.
            found = seeds(words)
            inside = np.ones(found.shape[1], bool)
            for end in ends[:-1]:
                inside[max(0, end - SPAN + 1) : end] = False
            inside = np.flatnonzero(inside)
            hits = [(inside[sifted(known.value, h[inside])], h) for h in found]
            at = np.concatenate([p for p, _ in hits])
            hashes = np.concatenate([h[p] for p, h in hits])
            order = np.argsort(at, kind="stable")
            at, hashes = at[order], hashes[order]
            of = np.searchsorted(ends, at, side="right")
            breaks = np.flatnonzero((np.diff(at) > 2 * around) | (np.diff(of) > 0)) + 1
            for part in np.split(np.arange(len(at)), breaks) if len(at) else ():
                i = of[part[0]]
                start = ends[i - 1] if i else 0
                first = max(start, int(at[part[0]]) - around)
                last = min(ends[i], int(at[part[-1]]) + SPAN + around)
                keys.append(b.column(0)[begin + int(i)].as_py())
                rows.append((first - start, words[first:last].view(np.int64), at[part] - first, hashes[part].view(np.int64)))
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, b.schema.types[0]), pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], kind) for i in (1, 2, 3))], ["key", "first", "words", "at", "hash"]
        )


def _in_parts(texts: list[str], most: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, list[int]]]:
    """Texts in parts of about ``most`` words: number of the first text, all words, and where each text ends."""
    begin, parts, ends = 0, [], []
    for i, text in enumerate(texts):
        parts.append(word_hashes(text))
        ends.append((ends[-1] if ends else 0) + len(parts[-1]))
        if ends[-1] >= most or i == len(texts) - 1:
            yield begin, np.concatenate(parts), ends
            begin, parts, ends = i + 1, [], []


def _item_seeds(pdf: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in pdf:
        for item, text in zip(b["item"], b["text"], strict=True):
            words = word_hashes(text)
            h = seeds(words)
            n = h.shape[1]
            yield pd.DataFrame({"item": item, "pos": np.tile(np.arange(n), len(h)), "hash": h.reshape(-1).view(np.int64)})


def _item_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"item": b["item"], "item_words": [word_hashes(t).view(np.int64) for t in b["text"]]})


def _longest(equal: np.ndarray) -> int:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], equal.astype(np.int8), [0]))))
    return int((edges[1::2] - edges[::2]).max()) if len(edges) else 0


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The overlap of a stretch and an item on one diagonal: equal words and the longest run of them."""
    for b in batches:
        rows = []
        for key, item, shift, words, theirs in zip(b["key"], b["item"], b["shift"], b["words"], b["item_words"], strict=True):
            lo, hi = max(0, -shift), min(len(theirs), len(words) - shift)
            equal = np.asarray(words)[lo + shift : hi + shift] == np.asarray(theirs)[lo:hi]
            rows.append((key, item, int(equal.sum()), _longest(equal), len(theirs)))
        yield pd.DataFrame(rows, columns=["key", "item", "n_equal", "longest_run", "n_words"])


def passages(docs: DataFrame, items: DataFrame, doc_key: str, item_key: str, text: str = "text") -> DataFrame:
    """Overlaps of ``docs`` with ``items``: doc key, item key, n_equal, longest_run, n_words.

    One row for each document and item that share a window of 12 words with at most one of them
    substituted, from the masks of :data:`IGNORED` (two or more may be, where one mask ignores
    them all). ``n_equal``: most equal words in place of each other over the whole item,
    ``longest_run``: most consecutive ones, ``n_words``: words of the item. Null, blank and
    shorter texts overlap nothing; equal documents or items each have their rows; keys should
    be unique, and other columns are ignored.

    The seeds of all windows are made in one pass over the texts, commands and comments
    included, and sifted there by a Bloom filter of the items' seeds, so hits and few others
    leave. More than :data:`SHARD_SEEDS` item seeds are divided by their hash, with a sieve and a
    pass for each part. Hits meet the items by a join on the seed; the places of a seed that many
    items have are cut into rows of about :data:`PLACES`, hot seeds and hot items meet by
    :func:`skew_join`, and every overlap is verified word by word.
    """
    spark = docs.sparkSession
    kinds = {k: df.schema[c].dataType.simpleString() for k, df, c in (("key", docs, doc_key), ("item", items, item_key))}
    asked = items.select(F.col(item_key).alias("item"), F.col(text).alias("text")).where("text IS NOT NULL")
    grain = stage(asked.mapInPandas(_item_seeds, f"item {kinds['item']}, pos bigint, hash bigint"), "leakage-seeds")
    item_words = stage(asked.mapInPandas(_item_words, f"item {kinds['item']}, item_words array<bigint>"), "leakage-items")
    around = (item_words.agg(F.max(F.size("item_words"))).first()[0] or 0) + SPAN
    places = grain.groupBy("hash").agg(F.ceil(F.count(F.lit(1)) / PLACES).alias("n_parts"))
    places = stage(places, "leakage-places")
    n = places.count()
    shards = max(1, -(-n // SHARD_SEEDS))
    rows = docs.select(F.col(doc_key).alias("key"), F.col(text).alias("text")).where("text IS NOT NULL")
    lines = None
    for shard in range(shards):
        own = places if shards == 1 else places.where(F.pmod("hash", F.lit(shards)) == shard)
        known = spark.sparkContext.broadcast(sieve(own.select("hash"), -(-n // shards)))
        found = rows.mapInArrow(lambda it, known=known: _segments(it, known, around), f"key {kinds['key']}, first bigint, words array<bigint>, at array<bigint>, hash array<bigint>")
        part = _lines(stage(found, "leakage-hits"), grain, own)
        lines = part if lines is None else lines.unionByName(part)
    full = skew_join(stage(lines, "leakage-lines"), item_words, ["item"]).select("key", "item", "shift", "words", "item_words")
    checked = full.mapInPandas(_verify, f"key {kinds['key']}, item {kinds['item']}, n_equal bigint, longest_run bigint, n_words bigint")
    best = checked.groupBy("key", "item").agg(F.max("n_equal").alias("n_equal"), F.max("longest_run").alias("longest_run"), F.max("n_words").alias("n_words"))
    return best.select(F.col("key").alias(doc_key), F.col("item").alias(item_key), "n_equal", "longest_run", "n_words")


def _lines(found: DataFrame, grain: DataFrame, places: DataFrame) -> DataFrame:
    """(key, item, shift, words): each diagonal on which a stretch of words shares a seed with an item."""
    hits = found.select("key", "first", F.explode(F.arrays_zip("at", "hash")).alias("h")).select("key", "first", F.col("h.at").alias("at"), F.col("h.hash").alias("hash"))
    hits = stage(hits, "leakage-seeds-hit")
    parts = grain.join(places, "hash").groupBy("hash", F.pmod(F.xxhash64("item", "pos"), "n_parts").alias("part")).agg(F.collect_list(F.struct("item", "pos")).alias("places"))
    met = skew_join(hits, places, ["hash"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_parts") - 1)))
    met = skew_join(stage(met.select("key", "first", "at", "hash", "part"), "leakage-met"), parts, ["hash", "part"]).select("key", "first", "at", F.explode("places").alias("p"))
    shifts = met.select("key", "first", F.col("p.item").alias("item"), (F.col("at") - F.col("p.pos")).alias("shift")).distinct()
    return shifts.join(found.select("key", "first", "words"), ["key", "first"]).select("key", "item", "shift", "words")


def p9_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every overlap of an article with an item, substitutions allowed, with its extent."""
    docs, items = read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text")
    return passages(docs, items, "doc_id", "item_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with at least 12 consecutive words of an item: doc_id, item_id."""
    return p9_overlaps(spark, sf_dir).where(F.col("longest_run") >= SPAN).select("doc_id", "item_id")


QUERIES = {"p9_found": p9_found, "p9_overlaps": p9_overlaps}
ORACLE: dict[str, str] = {}
