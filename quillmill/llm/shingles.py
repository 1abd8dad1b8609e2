"""Word triples as 64-bit rolling hashes, and a count sketch that orders them from rare to common."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions.text import words_of

WIDTH = 3  #: words in a shingle of questions and passages
MIN_WORDS = 12  #: shorter questions are similar to nothing
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


class _Codes(dict):
    """64-bit code of a word, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        v = self[word] = xxhash.xxh3_64_intdigest(word)
        return v


_codes = _Codes()


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values, so that any of their bits may serve as a bucket."""
    h = (h ^ (h >> _S33)) * _MIX1
    h = (h ^ (h >> _S33)) * _MIX2
    return h ^ (h >> _S33)


def shingle_texts(texts: list[str | None], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rolling hashes of all runs of ``width`` words, text after text: (hashes, per text, words per text).

    The hash of a run is the Karp-Rabin polynomial of its word codes modulo 2^64, mixed. Different runs
    collide with a chance of 2^-64 a pair.
    """
    per = [words_of(t) for t in texts]
    flat = [w for ws in per for w in ws]
    codes = np.fromiter(map(_codes.__getitem__, flat), dtype=np.uint64, count=len(flat))
    n_words = np.fromiter(map(len, per), dtype=np.int64, count=len(per))
    n = np.maximum(n_words - width + 1, 0)
    if len(codes) < width:
        return np.empty(0, dtype=np.uint64), n, n_words
    h = codes[: len(codes) - width + 1].copy()
    for k in range(1, width):
        h = h * _BASE + codes[k : len(codes) - width + 1 + k]
    owner_end = np.repeat(np.cumsum(n_words), n_words)[: len(h)]  # a run must not cross into the next text
    keep = np.arange(len(h)) + width <= owner_end
    return mix(h[keep]), n, n_words


def shingle_rows(df: DataFrame, keep: list[str], text_col: str, min_words: int = MIN_WORDS, width: int = WIDTH) -> DataFrame:
    """The columns ``keep`` and (cls, n, seq) of rows whose text has at least ``min_words`` words.

    ``seq`` holds the hashes of the text's shingles in order, ``n`` the number of distinct ones, ``cls`` a
    64-bit hash of ``seq``: equal texts (after normalisation) have equal ``cls``. Rows with a null or shorter
    text are left out. One narrow pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            h, n, words = shingle_texts(texts, width)
            stop = np.cumsum(n)
            rows = np.flatnonzero((words >= min_words) & (n > 0))
            parts = [h[stop[i] - n[i] : stop[i]] for i in rows]
            cls = np.array([xxhash.xxh3_64_intdigest(p.tobytes()) for p in parts], dtype=np.uint64).view(np.int64)
            distinct = np.array([len(np.unique(p)) for p in parts], dtype=np.int32)
            offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
            flat = np.concatenate(parts).view(np.int64) if parts else np.empty(0, dtype=np.int64)
            seq = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            kept = b.select(list(range(b.num_columns - 1))).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(cls), pa.array(distinct), seq], names=[*keep, "cls", "n", "seq"])

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    return df.select(*[df[k] for k in keep], df[text_col].alias("__text")).mapInArrow(run, f"{kinds}, cls bigint, n int, seq array<bigint>")


class Levels:
    """How common a shingle is, as a power of two, from a count sketch; 0 where only one group of texts has it.

    The sketch has 2**bits counters, each with a count and with the smallest and the largest group seen there.
    Every shingle has one level everywhere, so (level, hash) is one total order of all shingles, which is all that
    the joins rely on. Collisions can make a rare shingle look common, or one of a single group look shared; that
    costs time, never a result. ``load`` is the mean count of a counter: how much of a level is collisions.
    """

    def __init__(self, levels: np.ndarray, bits: int, load: float = 0.0) -> None:
        self.levels, self.shift, self.load = levels, np.uint64(64 - bits), load

    def of(self, h: np.ndarray) -> np.ndarray:
        """Level of each hash."""
        return self.levels[(h >> self.shift).astype(np.int64)]


MIN_BITS, MAX_BITS = 16, 25  #: counters of a sketch; 2**25 one-byte levels are the most that is broadcast


def count_levels(classes: DataFrame, group: str, bits: int | None = None) -> Levels:
    """Levels from the distinct shingles of every row of ``classes`` (seq, and ``group``, a bigint); counts all rows.

    Without ``bits`` the sketch has two counters for each shingle, within MIN_BITS and MAX_BITS. Counts are added up
    in every task first. Only (bucket, level) of buckets with several groups reach the driver, five bytes each.
    """
    total = int(classes.agg(F.sum(F.size("seq"))).first()[0] or 0)
    if bits is None:
        bits = min(MAX_BITS, max(MIN_BITS, (2 * total).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[tuple[np.ndarray, ...]] = []
        size = 0

        def rows() -> pa.RecordBatch:
            b, c, lo, hi = _merged(counts)
            return pa.RecordBatch.from_arrays([pa.array(b.astype(np.int32)), pa.array(c), pa.array(lo), pa.array(hi)], names=["b", "c", "lo", "hi"])

        for b in batches:
            h, _, owner = seq_arrays(b.column(0))
            first = _firsts(owner, h)
            bucket = (h[first] >> np.uint64(64 - bits)).astype(np.int64)
            who = b.column(1).to_numpy()[owner[first]]
            counts.append((bucket, np.ones(len(bucket), dtype=np.int64), who, who))
            size += len(bucket)
            if size >= 4_000_000:
                counts = [_merged(counts)]
                size = len(counts[0][0])
                if size >= 2_000_000:
                    yield rows()
                    counts, size = [], 0
        if counts:
            yield rows()

    summed = classes.select("seq", group).mapInArrow(run, "b int, c bigint, lo bigint, hi bigint").groupBy("b").agg(F.sum("c").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    got = summed.where("lo <> hi").select("b", F.floor(F.log2("c")).cast("tinyint").alias("l")).toArrow()
    levels = np.zeros(1 << bits, dtype=np.uint8)
    if got.num_rows:
        levels[got.column("b").to_numpy()] = np.maximum(got.column("l").to_numpy(), 1)
    return Levels(levels, bits, total / (1 << bits))


def _merged(counts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Counts, smallest and largest groups by bucket."""
    b, c, lo, hi = (np.concatenate(x) for x in zip(*counts))
    if not len(b):
        return b, c, lo, hi
    order = np.argsort(b, kind="stable")
    b = b[order]
    at = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
    return b[at], np.add.reduceat(c[order], at), np.minimum.reduceat(lo[order], at), np.maximum.reduceat(hi[order], at)


def _firsts(owner: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of the first occurrence of each (owner, hash)."""
    order = np.lexsort((h, owner))
    o, x = owner[order], h[order]
    new = np.ones(len(o), dtype=bool)
    new[1:] = (o[1:] != o[:-1]) | (x[1:] != x[:-1])
    return order[new]


def seq_arrays(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A list column of hashes as (all hashes, rows' offsets, owner row of each hash)."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    h = column.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64)
    n = np.diff(offsets)
    return h, offsets - offsets[0], np.repeat(np.arange(len(n)), n)
