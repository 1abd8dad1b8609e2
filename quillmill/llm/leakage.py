"""Test passages inside a corpus: greedy string tiling over shared word triples.

A text that holds half of a question's triples holds one of any n - ceil(n/2) + 1 of them. So each question shows
that many, those first that the fewest questions have: what many questions of one template share comes last and
makes no seeds. Tables of bounded size hold which triples tests have and how many a shown one needs beside it; one narrow
pass over the corpus hashes every run of three words (Karp-Rabin) and keeps the texts that may hold enough. Their triples are then joined with
the shown ones, by broadcast where these are proven few, else by a shuffle with every key split; each pair of a text
and a question that meets is tiled: matches are marked greedily from the longest down, never overlapping in either
text, so reordered parts of a passage are all found, and the pair counts if the share of the question's distinct
triples reaches the threshold. Neither questions nor seeds go to the driver.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.encode import chunks
from quillmill.llm.shingles import WIDTH, _firsts, seq_arrays, shingle_rows, shingle_texts
from quillmill.session import cut

BROADCAST_ROWS = 2_000_000  #: shown triples, or tiled pairs, up to which a side is broadcast (about 100 MB)
MAX_BITS, MAX_NEED_BITS = 27, 24  #: the tables of triples have at most 2**27 bits and 2**24 bytes, 16 MB each
SALTS = 16  #: parts that every triple is split into when it is joined by a shuffle


def shown_triples(tests: DataFrame, share: float) -> DataFrame:
    """(triple, test, n): the triples that each test (cls, n, seq) must show, those of the fewest tests first."""
    each = tests.select("cls", "n", F.explode(F.array_distinct("seq")).alias("triple"))
    counts = each.groupBy("triple").agg(F.count(F.lit(1)).alias("often"))
    order = Window.partitionBy("cls").orderBy("often", "triple")
    ranked = each.join(counts.withColumnRenamed("triple", "__t"), F.col("triple") == F.col("__t")).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= F.col("n") - F.ceil(F.lit(share) * F.col("n") - F.lit(1e-9)) + 1).select("triple", F.col("cls").alias("test"), "n")


class Shown:
    """Bitmap of all triples of the tests, and for every shown triple the fewest triples that a test showing it needs.

    Both are hashed into tables of a bounded size, so they may say yes wrongly or need too little, never the reverse.
    """

    def __init__(self, words: np.ndarray, bits: int, needs: np.ndarray, need_bits: int) -> None:
        self.words, self.bits, self.needs, self.need_bits = words, bits, needs, need_bits

    def has(self, h: np.ndarray) -> np.ndarray:
        """Which hashes may be triples of a test."""
        at = h >> np.uint64(64 - self.bits)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0

    def need(self, h: np.ndarray) -> np.ndarray:
        """The fewest triples needed by a test that shows each hash; 255 where none does (or for 255 and more)."""
        return self.needs[(h >> np.uint64(64 - self.need_bits)).astype(np.int64)]


def tables(tests: DataFrame, shown: DataFrame, n: int, share: float) -> Shown:
    """The tables of the tests (cls, n, seq) and their ``n`` shown triples, put together before they reach the driver."""
    bits = min(MAX_BITS, max(12, (64 * n).bit_length()))
    every = tests.select(F.explode("seq").alias("triple"))
    at = F.shiftrightunsigned("triple", 64 - bits)
    words = every.groupBy(F.shiftrightunsigned(at, 6).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(triple, {64 - bits}) & 63 as int))")).alias("m")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    if words.num_rows:
        out[words.column("w").to_numpy()] = words.column("m").to_numpy().view(np.uint64)
    need_bits = min(MAX_NEED_BITS, max(12, (16 * n).bit_length()))
    need = F.least(F.lit(254), F.ceil(F.lit(share) * F.col("n") - F.lit(1e-9)))
    low = shown.groupBy(F.shiftrightunsigned("triple", 64 - need_bits).cast("int").alias("b")).agg(F.min(need).cast("smallint").alias("need")).toArrow()
    needs = np.full(1 << need_bits, 255, dtype=np.uint8)
    if low.num_rows:
        needs[low.column("b").to_numpy()] = low.column("need").to_numpy()
    return Shown(out, bits, needs, need_bits)


def candidate_texts(corpus: DataFrame, keep: list[str], text_col: str, shown: Shown) -> DataFrame:
    """(keep..., cls, seq, seeds) of the texts that may hold enough of a test; one narrow pass over the corpus.

    A text that holds enough of a test has a triple that the test shows, and as many triples of any tests as it needs.
    """
    shared = corpus.sparkSession.sparkContext.broadcast(shown)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in chunks(b.column(b.num_columns - 1).to_pylist()):
                h, n, _ = shingle_texts(texts)
                at = np.flatnonzero(shared.value.has(h))
                owner = np.repeat(np.arange(len(texts)), n)[at]
                known = h[at]
                new = _firsts(owner, known)
                owner, known = owner[new], known[new]  # distinct, by text
                count = np.bincount(owner, minlength=len(texts))
                need = shared.value.need(known)
                seed = (need < 255) & (need <= np.minimum(count[owner], 254))
                owner, known = owner[seed], known[seed]
                rows, first_seed = np.unique(owner, return_index=True)
                if not len(rows):
                    continue
                begin = np.cumsum(n) - n
                parts = [h[begin[i] : begin[i] + n[i]] for i in rows]
                seeds = np.split(known, first_seed[1:])
                lists = lambda xs: pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in xs])))), pa.array(np.concatenate(xs).view(np.int64))).cast(pa.list_(pa.int64()))
                cls = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in parts], dtype=np.uint64).view(np.int64)
                kept = b.select(list(range(b.num_columns - 1))).take(pa.array(rows + first))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(cls), lists(parts), lists(seeds)], names=[*keep, "cls", "seq", "seeds"])

    kinds = ", ".join(f"`{k}` {corpus.schema[k].dataType.simpleString()}" for k in keep)
    src = corpus.select(*[corpus[k] for k in keep], corpus[text_col].alias("__text"))
    return src.mapInArrow(run, f"{kinds}, cls bigint, seq array<bigint>, seeds array<bigint>")


def seed_pairs(texts: DataFrame, shown: DataFrame, n_shown: int, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(cls, test): pairs of a text and a test with a shown triple in common."""
    seeds = texts.select("cls", F.explode("seeds").alias("seed"))
    if n_shown <= broadcast_rows:
        met = seeds.join(F.broadcast(shown), F.col("seed") == F.col("triple"))
    else:
        # a triple that a third of the texts have is met in SALTS parts
        salted = shown.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        met = seeds.withColumn("__salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int")).join(salted, (F.col("seed") == F.col("triple")) & (F.col("__salt") == F.col("salt")))
    return met.select("cls", "test").distinct()


def tiles(a: np.ndarray, b: np.ndarray, starts: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Greedy string tiling from seeds: (place in a, place in b, triples), longest first, none overlapping.

    ``a`` and ``b`` are the triple hashes of the two texts, ``starts`` the places of equal triples. A tile of k
    triples covers k + WIDTH - 1 words; tiles may not share a triple in either text. Ties go to the earlier
    place in ``a``, then in ``b``.
    """
    diagonal = defaultdict(list)
    for i, j in starts:
        diagonal[j - i].append(i)
    runs = []
    for d, places in diagonal.items():
        places.sort()
        first = last = places[0]
        for i in places[1:]:
            if i != last + 1:
                runs.append((last - first + 1, first, first + d))
                first = i
            last = i
        runs.append((last - first + 1, first, first + d))
    runs.sort(key=lambda r: (-r[0], r[1], r[2]))
    free_a, free_b, out = np.ones(len(a), dtype=bool), np.ones(len(b), dtype=bool), []
    heap = [(-n, i, j) for n, i, j in runs]
    heapq.heapify(heap)
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        ok = free_a[i : i + n] & free_b[j : j + n]
        if ok.all():
            out.append((i, j, n))
            free_a[i : i + n] = False
            free_b[j : j + n] = False
            continue
        # what is left of the run after earlier tiles goes back, piece by piece
        edges = np.flatnonzero(np.diff(np.concatenate(([0], ok.view(np.int8), [0]))))
        for s, e in zip(edges[::2], edges[1::2]):
            heapq.heappush(heap, (-int(e - s), i + int(s), j + int(s)))
    return out


def tiled(pairs: DataFrame, share: float) -> DataFrame:
    """(cls, test, triples, shared, tile_words) of the pairs (cls, test, seq, test_seq) that reach the share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ha, oa, _ = seq_arrays(b.column(2))
            hb, ob, _ = seq_arrays(b.column(3))
            out: list[tuple[int, int, int, int]] = []
            for i in range(b.num_rows):
                x, y = ha[oa[i] : oa[i + 1]], hb[ob[i] : ob[i + 1]]
                known = np.unique(y)
                need = max(1, int(np.ceil(share * len(known) - 1e-9)))
                if len(np.intersect1d(np.unique(x), known, assume_unique=True)) < need:
                    continue
                order = np.argsort(y, kind="stable")
                lo, hi = np.searchsorted(y[order], x, "left"), np.searchsorted(y[order], x, "right")
                at = np.flatnonzero(hi > lo)
                places = [(int(p), int(q)) for p in at for q in order[lo[p] : hi[p]]]
                marked = tiles(x, y, places)
                inside = {int(v) for _, j, k in marked for v in y[j : j + k]}
                if len(inside) >= need:
                    out.append((i, len(known), len(inside), sum(k + WIDTH - 1 for _, _, k in marked)))
            rows = pa.array([o[0] for o in out], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), *(pa.array([o[k] for o in out], pa.int32()) for k in (1, 2, 3))], names=["cls", "test", "triples", "shared", "tile_words"])

    return pairs.select("cls", "test", "seq", "test_seq").mapInArrow(run, "cls bigint, test bigint, triples int, shared int, tile_words int")


def leaked(corpus: DataFrame, tests: DataFrame, keep: list[str], text_col: str, test_id: str, test_text: str, share: float = 0.5, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(keep..., test_id, triples, shared, tile_words): texts holding at least ``share`` of a question's triples.

    Questions of fewer than three words (or null) have no triple and are in no text; null and empty texts hold
    nothing. Every corpus row counts for itself, equal texts and equal questions are compared once. The columns of
    the result are named as given; a name of ``keep`` may not be cls, seq, seeds or test.
    """
    named = [f"__k{i}" for i in range(len(keep))]
    src = corpus.select(*[corpus[k].alias(n) for k, n in zip(keep, named)], corpus[text_col].alias("__body"))
    asked = cut(shingle_rows(tests.select(F.col(test_id).alias("__test"), F.col(test_text).alias("__q")), ["__test"], "__q", min_words=WIDTH), "tests")
    questions = asked.select("cls", "n", "seq").dropDuplicates(["cls"])
    shown = cut(shown_triples(questions, share), "shown")
    n_shown = shown.count()
    texts = cut(candidate_texts(src, named, "__body", tables(questions, shown, n_shown, share)), "leak-texts")
    met = cut(seed_pairs(texts.dropDuplicates(["cls"]), shown.select("triple", "test"), n_shown, broadcast_rows), "leak-seeds")
    sides = questions.select(F.col("cls").alias("__q"), F.col("seq").alias("test_seq"))
    bodies = texts.select(F.col("cls").alias("__c"), "seq").dropDuplicates(["__c"])
    full = met.join(bodies, F.col("cls") == F.col("__c")).join(sides, F.col("test") == F.col("__q"))
    hits = cut(tiled(full, share), "leaks")
    rows = texts.select(*named, F.col("cls").alias("__c"))
    ids = asked.select(F.col("__test"), F.col("cls").alias("__q")).distinct()
    out = hits.join(rows, F.col("cls") == F.col("__c")).join(ids, F.col("test") == F.col("__q"))
    return out.select(*[F.col(n).alias(k) for n, k in zip(named, keep)], F.col("__test").alias(test_id), "triples", "shared", "tile_words")
