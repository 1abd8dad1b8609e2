"""Same or near-same records across splits: winnowing fingerprints, chained seeds, aligned coverage.

Of every window of WINDOW consecutive word triples the smallest rolling hash is a fingerprint, so two texts
with a common run of WINDOW triples share one. Smallest means rarest first: the order is (level of a count
sketch, hash), the same for all texts; triples that only one side has come first of all, since windows that hold one
lie in no common run, and aren't sent. A window may hold common triples only; its fingerprint is then too
common to join on, and the text shows instead its n - ceil(t*n) + 1 rarest triples, of which two texts of
similarity t always share one, so nothing is dropped. Sizes and parity sketches (see neardup), which bound the
difference of two texts from below, are compared inside the join. Texts whose triples repeat show those as well, since
repetition could break every common run. Candidate pairs come with the places of their fingerprints (seeds);
seeds in line are chained, extended by alignment to the left and right, and the covered triples reported; the
exact similarity decides.

Why windows lose no pair: an edit inside a text costs at least two triples in each of the two texts, and at a
similarity of 0.7 at most 0.43 c triples differ for c common ones. So there are at most 0.107 c breaks, and
the longest common run has at least c / (0.107 c + 1) >= 5 triples for texts of 12 words or more.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.neardup import WORDS, similarity, sketch_distance, sketches
from quillmill.llm.shingles import Levels, _firsts, count_levels, seq_arrays, shingle_rows
from quillmill.session import cut

WINDOW = 4
HOT_LEVEL = 6  #: triples in 2**6 texts or more, beyond what collisions add, are too common to join on


def winnow(key: np.ndarray, owner: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places that hold the smallest key of a window of their owner; shorter owners have one window."""
    n = len(key)
    if not n:
        return np.empty(0, dtype=np.int64)
    starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    size = np.diff(np.concatenate((starts, [n])))
    begins = np.arange(n)
    last = np.repeat(starts + np.maximum(size - window, 0), size)  # last begin of a window of the owner
    stop = np.repeat(starts + size, size)
    begins = begins[begins <= last]
    best = key[begins]
    for k in range(1, window):
        at = begins + k
        inside = at < stop[begins]
        best = np.where(inside, np.minimum(best, key[np.minimum(at, n - 1)]), best)
    chosen = np.zeros(n, dtype=bool)
    for k in range(window):
        at = np.minimum(begins + k, n - 1)
        chosen[at[(begins + k < stop[begins]) & (key[at] == best)]] = True
    return np.flatnonzero(chosen)


def order_keys(h: np.ndarray, levels: Levels) -> np.ndarray:
    """One number a hash whose order is rare to common, then by hash."""
    return levels.of(h).astype(np.uint64) << np.uint64(58) | h >> np.uint64(6)


def fingerprints(classes: DataFrame, levels: Levels, t: float, hot_level: int = HOT_LEVEL) -> DataFrame:
    """(fp, cls, n, place, training, s0..s3): the fingerprints of every text, with its size and parity sketch.

    A fingerprint stands at the first place of its triple in a text, so a pair of texts has one seed a fingerprint.
    """
    shared = classes.sparkSession.sparkContext.broadcast(levels)
    # what the sketch's collisions add to every counter makes nothing hot
    bound = hot_level + int(np.ceil(np.log2(1 + levels.load)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lv = shared.value
        for b in batches:
            h, offsets, owner = seq_arrays(b.column(3))
            key = order_keys(h, lv)
            n = b.column(1).to_numpy()
            chosen = winnow(key, owner)
            hot = lv.of(h[chosen]) >= bound
            full = np.zeros(b.num_rows, dtype=bool)  # texts that show their rarest triples too
            full[owner[chosen[hot]]] = True
            full |= np.diff(offsets) > n
            first = _firsts(owner, h)
            once = np.flatnonzero(np.concatenate(([True], np.diff(owner[first]) != 0))) if len(first) else np.empty(0, np.int64)
            sketch = sketches(h[first], once) if len(first) else [np.empty(0, np.int64)] * WORDS
            stands = np.zeros(len(h), dtype=bool)
            stands[first] = True
            first = first[full[owner[first]]]
            first = first[np.lexsort((key[first], owner[first]))]
            o = owner[first]
            begin = np.searchsorted(o, o, "left")
            rarest = first[np.arange(len(o)) - begin < n[o] - np.ceil(t * n[o] - 1e-9).astype(np.int64) + 1]
            picked = chosen[~hot]
            if len(picked) and not stands[picked].all():  # a repeated triple: its first place stands for it
                order = np.lexsort((np.arange(len(h)), h, owner))
                new = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])))
                lead = np.empty(len(h), dtype=np.int64)
                lead[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
                picked = lead[picked]
            at = np.unique(np.concatenate([picked, rarest]))
            at = at[lv.of(h[at]) > 0]  # only one side has it
            row = owner[at]
            cols = [h[at].view(np.int64), b.column(0).to_numpy()[row], n[row], (at - offsets[row]).astype(np.int32), np.asarray(b.column(2))[row], *(x[row] for x in sketch)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["fp", "cls", "n", "place", "training", *(f"s{k}" for k in range(WORDS))])

    src = classes.select("cls", "n", "training", "seq")
    return src.mapInArrow(run, "fp bigint, cls bigint, n int, place int, training boolean, " + ", ".join(f"s{k} bigint" for k in range(WORDS)))


def chain(seeds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest chain of seeds that ascend in both texts (a longest increasing subsequence, in n log n)."""
    order = sorted(set(seeds), key=lambda s: (s[0], -s[1]))  # of seeds at one place only one can be taken
    tops: list[int] = []  # smallest end of a chain of each length
    at: list[int] = []
    back: list[int] = []
    for i, (_, y) in enumerate(order):
        k = bisect_left(tops, y)
        if k == len(tops):
            tops.append(y)
            at.append(i)
        else:
            tops[k], at[k] = y, i
        back.append(at[k - 1] if k else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(order[i])
        i = back[i]
    return out[::-1]


def covered(a: np.ndarray, b: np.ndarray, seeds: list[tuple[int, int]]) -> tuple[int, int]:
    """Triples of a and of b that the chained seeds cover once extended to both sides along equal triples."""
    in_a, in_b = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
    for i, j in chain(seeds):
        if in_a[i] and in_b[j]:
            continue
        k = min(len(a) - i, len(b) - j)
        right = int(np.argmin(np.concatenate((a[i : i + k] == b[j : j + k], [False]))))
        k = min(i, j)
        left = int(np.argmin(np.concatenate((a[i - k : i][::-1] == b[j - k : j][::-1], [False]))))
        in_a[i - left : i + right] = True
        in_b[j - left : j + right] = True
    return int(in_a.sum()), int(in_b.sum())


def aligned(pairs: DataFrame, classes: DataFrame, t: float) -> DataFrame:
    """(a, b, similarity, cover_a, cover_b) of candidate pairs (a, b, seeds) of similarity of at least t."""
    x = classes.select(F.col("cls").alias("__x"), F.col("seq").alias("sx"))
    y = classes.select(F.col("cls").alias("__y"), F.col("seq").alias("sy"))
    full = pairs.join(x, F.col("a") == F.col("__x")).join(y, F.col("b") == F.col("__y")).select("a", "b", "seeds", "sx", "sy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hx, ox, _ = seq_arrays(b.column(3))
            hy, oy, _ = seq_arrays(b.column(4))
            rows = []
            for i in range(b.num_rows):
                p, q = hx[ox[i] : ox[i + 1]], hy[oy[i] : oy[i + 1]]
                s = similarity(p, q)
                if s >= t - 1e-12:
                    seeds = [(d["x"], d["y"]) for d in b.column(2)[i].as_py()]
                    ca, cb = covered(p, q, seeds)
                    rows.append((i, s, ca / len(p), cb / len(q)))
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), *(pa.array([r[k] for r in rows], pa.float64()) for k in (1, 2, 3))],
                names=["a", "b", "similarity", "cover_a", "cover_b"],
            )

    return full.mapInArrow(run, "a bigint, b bigint, similarity double, cover_a double, cover_b double")


def cross_split(records: DataFrame, id_col: str, text_col: str, training_col: str, t: float = 0.7, bits: int | None = None) -> DataFrame:
    """(train_id, eval_id, similarity, train_cover, eval_cover): overlaps of training with evaluation records.

    ``training_col`` is true for training, false for evaluation; records with null belong to neither. Null,
    empty and short texts are similar to nothing; rows delivered again count once; equal texts of a side are
    one class until the end, so copies don't multiply the work, only the pairs that are asked for.
    """
    side = records.where(F.col(id_col).isNotNull() & F.col(training_col).isNotNull())
    src = side.select(F.col(id_col).alias("__id"), F.col(training_col).alias("training"), F.col(text_col).alias("__t"))
    rows = cut(shingle_rows(src, ["__id", "training"], "__t"), "overlap-rows")
    members = rows.select("__id", "training", "cls").distinct()
    classes = cut(rows.select("cls", "n", "training", "seq").dropDuplicates(["cls", "training"]), "overlap-classes")
    levels = count_levels(classes.withColumn("side", F.col("training").cast("int").cast("bigint")), "side", bits)
    fps = fingerprints(classes, levels, t)
    a, b = fps.where("training").alias("a"), fps.where("not training").alias("b")
    na, nb = F.col("a.n"), F.col("b.n")
    near = (
        (F.col("a.fp") == F.col("b.fp"))
        & (F.least(na, nb) >= F.lit(t) * F.greatest(na, nb) - F.lit(1e-9))
        & (sketch_distance("a", "b") <= F.floor(F.lit((1 - t) / (1 + t)) * (na + nb) + F.lit(1e-9)))
    )
    met = a.join(b, near).select(F.col("a.cls").alias("a"), F.col("b.cls").alias("b"), F.col("a.place").alias("x"), F.col("b.place").alias("y"))
    seeds = met.groupBy("a", "b").agg(F.collect_set(F.struct("x", "y")).alias("seeds"))
    once = classes.select("cls", "seq").dropDuplicates(["cls"])
    pairs = cut(aligned(cut(seeds, "overlap-seeds"), once, t), "overlap-pairs")
    ma = members.where("training").select(F.col("__id").alias("train_id"), F.col("cls").alias("__a"))
    mb = members.where("not training").select(F.col("__id").alias("eval_id"), F.col("cls").alias("__b"))
    out = pairs.join(ma, F.col("a") == F.col("__a")).join(mb, F.col("b") == F.col("__b"))
    return out.select("train_id", "eval_id", "similarity", F.col("cover_a").alias("train_cover"), F.col("cover_b").alias("eval_cover"))
