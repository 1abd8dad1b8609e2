"""Near-duplicates with small edits: parity sketches, joined by the pigeonhole principle in size bands, and verified.

A text is the set of its word triples. Its parity sketch XORs the hashes of the triples into blocks, a triple into
the block that its hash names. A triple that only one of two texts has changes one block at most, so if two texts
differ in fewer triples than the sketch has blocks, a block agrees: the pigeonhole. How many blocks a sketch has
follows from the size band of the larger text (about four triples a block), and band, block and value are the key on
which texts meet. So every pair meets whose symmetric difference is below a quarter of its band's size (similarity
0.8 and more). All texts of a key are linked to its smallest one only, not to each other, and the links verified:
a cluster of any size costs one link a text and block.

What is left are links between the components found so far, of similarity t to 0.8 or lost to a star's centre.
There the blocks are single triples (the sketch at its finest), of which a set must show n - ceil(t*n) + 1, in an
order that puts triples first that only one component has: those meet nothing and aren't sent. A 256-bit parity
sketch, whose Hamming distance bounds the symmetric difference from below, prunes inside that join, pairs within a
component are left out, and what passes is verified exactly. No link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.components import connected_components
from quillmill.llm.shingles import Levels, _firsts, count_levels, mix, seq_arrays, shingle_rows
from quillmill.llm.skew import join_hot
from quillmill.session import cut

WORDS = 4  #: 64-bit words of the sketch that is compared bit by bit
BLOCK_TRIPLES = 4  #: triples a block of the sketch whose blocks are joined


def sketches(h: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Parity sketches of consecutive sets of distinct hashes, as WORDS arrays of 64 bits."""
    bit = np.uint64(1) << (h & np.uint64(63))
    word = (h >> np.uint64(6)) % np.uint64(WORDS)
    return [np.bitwise_xor.reduceat(np.where(word == np.uint64(k), bit, np.uint64(0)), starts).view(np.int64) for k in range(WORDS)]


def sketch_distance(a: str, b: str) -> Column:
    """Hamming distance of the sketches of the rows aliased a and b."""
    return reduce(add, (F.bit_count(F.col(f"{a}.s{k}").bitwiseXOR(F.col(f"{b}.s{k}"))) for k in range(WORDS)))


def kept(n: np.ndarray, t: float) -> np.ndarray:
    """Positions that a set of n elements must show so that none of its partners is missed."""
    return n - np.ceil(t * n - 1e-9).astype(np.int64) + 1


def kept_small(n: Column, t: float) -> Column:
    """As kept, for the smaller set of a pair: it can miss fewer elements in a larger one."""
    return n - F.ceil(F.lit(2 * t / (1 + t)) * n - F.lit(1e-9)) + F.lit(1)


def band_of(n: np.ndarray) -> np.ndarray:
    """Size band: half a power of two wide."""
    return np.floor(2 * np.log2(np.maximum(n, 1)) + 1e-9).astype(np.int64)


def blocks_of(band: np.ndarray) -> np.ndarray:
    """Blocks of the sketches of a band: one for every BLOCK_TRIPLES triples of its smallest set."""
    return np.maximum(np.ceil(2 ** (band / 2) / BLOCK_TRIPLES).astype(np.int64), 2)


def block_keys(classes: DataFrame) -> DataFrame:
    """(key, cls): band, block and value of every block that is not empty, of a set's own band and of the next.

    A pair meets in the band of its larger set, so the smaller one also shows itself in the band that it could reach
    with the difference that the pigeonhole allows (it is never two bands away).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, _, owner = seq_arrays(b.column(1))
            first = _firsts(owner, h)
            h, owner = h[first], owner[first]
            n = np.bincount(owner, minlength=b.num_rows)
            keys, rows = [], []
            for up in (0, 1):
                band = band_of(n) + up
                blocks = blocks_of(band)
                here = np.ones(len(n), dtype=bool) if not up else band_of(n + blocks - 1) >= band
                take = here[owner]
                x, o = h[take], owner[take]
                if not len(x):
                    continue
                block = ((mix(x ^ np.uint64(0xA5A5)) >> np.uint64(32)) * blocks[o].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
                cell = o * np.int64(1 << 20) + block
                order = np.argsort(cell, kind="stable")
                cell = cell[order]
                at = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
                value = np.bitwise_xor.reduceat(x[order], at)
                row = cell[at] >> 20
                keys.append(mix(value ^ mix((band[row] * (1 << 20) + (cell[at] & 0xFFFFF) + 1).astype(np.uint64))))
                rows.append(row)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), b.column(0).take(pa.array(np.concatenate(rows)))], names=["key", "cls"])

    return classes.select("cls", "seq").mapInArrow(run, "key bigint, cls bigint")


def stars(keys: DataFrame) -> DataFrame:
    """(a, b): the smallest set of each key with every other set of that key, distinct."""
    centres = keys.groupBy("key").agg(F.min("cls").alias("a"), F.max("cls").alias("__top")).where("a <> __top").select(F.col("key").alias("__k"), "a")
    return keys.join(centres, F.col("key") == F.col("__k")).where("a <> cls").select("a", F.col("cls").alias("b")).distinct()


def postings(classes: DataFrame, levels: Levels, t: float) -> DataFrame:
    """(token, cls, part, n, rank, s0..s3): the elements that each set must show, with its component, size and sketch."""
    shared = classes.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lv = shared.value
        for b in batches:
            h, _, owner = seq_arrays(b.column(2))
            first = _firsts(owner, h)
            h, owner = h[first], owner[first]
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.empty(0, np.int64)
            if not len(starts):
                continue
            n = np.diff(np.concatenate((starts, [len(h)])))
            level = lv.of(h)
            order = np.lexsort((h, level, owner))
            rank = np.arange(len(h)) - np.repeat(starts, n)
            # level 0: no other component has the element
            take = (rank < np.repeat(kept(n, t), n)) & (level[order] > 0)
            row = owner[order][take]
            at = np.searchsorted(owner[starts], row)
            s = sketches(h, starts)
            cols = [h[order][take].view(np.int64), b.column(0).to_numpy()[row], b.column(1).to_numpy()[row], n[at].astype(np.int32), rank[take].astype(np.int32), *(x[at] for x in s)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["token", "cls", "part", "n", "rank", *(f"s{k}" for k in range(WORDS))])

    return classes.select("cls", "part", "seq").mapInArrow(run, "token bigint, cls bigint, part bigint, n int, rank int, " + ", ".join(f"s{k} bigint" for k in range(WORDS)))


def candidates(rows: DataFrame, t: float) -> DataFrame:
    """(a, b): distinct pairs of sets of two components that share a shown element and whose sizes and sketches allow t."""
    a, b = rows.alias("a"), rows.alias("b")
    na, nb = F.col("a.n"), F.col("b.n")
    on = (
        (F.col("a.token") == F.col("b.token"))
        & (F.col("a.part") != F.col("b.part"))
        & ((na < nb) | ((na == nb) & (F.col("a.cls") < F.col("b.cls"))))
        & (na >= F.lit(t) * nb - F.lit(1e-9))
        & (F.col("a.rank") < kept_small(na, t))
        & (sketch_distance("a", "b") <= F.floor(F.lit((1 - t) / (1 + t)) * (na + nb) + F.lit(1e-9)))
    )
    return a.join(b, on).select(F.col("a.cls").alias("a"), F.col("b.cls").alias("b")).distinct()


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Shared over all distinct elements; 0 for two empty sets."""
    x, y = np.unique(x), np.unique(y)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 0.0


def verified(pairs: DataFrame, classes: DataFrame, t: float) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b) whose exact similarity is at least t."""
    x = classes.select(F.col("cls").alias("__x"), F.col("seq").alias("sx"))
    y = classes.select(F.col("cls").alias("__y"), F.col("seq").alias("sy"))
    full = pairs.join(x, F.col("a") == F.col("__x")).join(y, F.col("b") == F.col("__y")).select("a", "b", "sx", "sy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hx, ox, _ = seq_arrays(b.column(2))
            hy, oy, _ = seq_arrays(b.column(3))
            s = np.array([similarity(hx[ox[i] : ox[i + 1]], hy[oy[i] : oy[i + 1]]) for i in range(b.num_rows)], dtype=np.float64)
            good = pa.array(s >= t - 1e-12)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(good), b.column(1).filter(good), pa.array(s).filter(good)], names=["a", "b", "similarity"])

    return full.mapInArrow(run, "a bigint, b bigint, similarity double")


def text_classes(tasks: DataFrame, keep: list[str], text_col: str) -> tuple[DataFrame, DataFrame]:
    """(members: keep..., cls), (classes: cls, n, seq): records, and each distinct text once; written tables."""
    rows = cut(shingle_rows(tasks, keep, text_col), "shingles")
    return rows.select(*keep, "cls").distinct(), cut(rows.select("cls", "n", "seq").dropDuplicates(["cls"]), "classes")


def near_components(classes: DataFrame, t: float, bits: int | None = None) -> DataFrame:
    """(cls, part): the component of every set under pairs of similarity of at least t, named by a set of it."""
    met = cut(verified(cut(stars(block_keys(classes)), "stars"), classes, t).select("a", "b"), "star-links")
    dense = connected_components(met)
    parted = classes.join(dense, classes["cls"] == dense["node"], "left").select("cls", "seq", F.coalesce("root", "cls").alias("part"))
    parted = cut(parted, "parted")
    levels = count_levels(parted, "part", bits)
    across = cut(verified(cut(candidates(postings(parted, levels, t), t), "candidates"), classes, t).select("a", "b"), "links")
    parts = parted.select("cls", "part")
    pa_, pb = parts.select(F.col("cls").alias("__x"), F.col("part").alias("u")), parts.select(F.col("cls").alias("__y"), F.col("part").alias("v"))
    bridges = across.join(pa_, F.col("a") == F.col("__x")).join(pb, F.col("b") == F.col("__y")).select("u", "v").distinct()
    joined = connected_components(bridges).select(F.col("node").alias("__n"), F.col("root").alias("__r"))
    return parts.join(joined, parts["part"] == F.col("__n"), "left").select("cls", F.coalesce("__r", "part").alias("part"))


def near_groups(tasks: DataFrame, id_col: str, text_col: str, t: float, bits: int | None = None) -> DataFrame:
    """(id, group_id): records whose texts are connected by pairs of similarity of at least t.

    Only records with a similar or equal other record have a row; group_id is the smallest id of the group.
    Null, empty and short texts are similar to nothing. Rows delivered again count once. Equal texts are one
    class, so copies cost nothing however many there are.
    """
    members, classes = text_classes(tasks.where(F.col(id_col).isNotNull()), [id_col], text_col)
    parts = near_components(classes, t, bits).select(F.col("cls").alias("__c"), "part")
    named = cut(members.join(parts, members["cls"] == F.col("__c")).select(id_col, F.col("part").alias("root")).distinct(), "near-members")
    names = named.groupBy("root").agg(F.min(id_col).alias("group_id"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    return join_hot(named, "root", names, "root", "__n").select(id_col, "group_id")


def group_pairs(members: DataFrame, id_col: str) -> DataFrame:
    """(id_a, id_b): all pairs of ids of the same group, id_a < id_b; read members from a written table."""
    a = members.select(F.col(id_col).alias("id_a"), "group_id")
    b = members.select(F.col(id_col).alias("id_b"), F.col("group_id").alias("__g"))
    return a.join(b, (F.col("group_id") == F.col("__g")) & (F.col("id_a") < F.col("id_b"))).select("id_a", "id_b")
