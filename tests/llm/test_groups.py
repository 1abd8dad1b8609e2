"""Components, splits, near-duplicates and overlaps against brute force, and their edge cases."""

from __future__ import annotations

import random
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.functions.text import words_of
from quillmill.llm import components as C
from quillmill.llm import neardup as N
from quillmill.llm import overlap as O
from quillmill.llm import splits as S

VOCAB = [f"w{i}" for i in range(400)]


def triples(text):
    w = words_of(text)
    return frozenset(zip(w, w[1:], w[2:])) if len(w) >= 12 else None


def jaccard(a, b):
    return len(a & b) / len(a | b)


def variants(rng, base, n):
    """Copies of a text with a few words replaced, dropped, inserted or moved."""
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randint(0, 6)):
            i = rng.randrange(len(w))
            match rng.randrange(4):
                case 0:
                    w[i] = rng.choice(VOCAB)
                case 1 if len(w) > 14:
                    del w[i]
                case 2:
                    w.insert(i, rng.choice(VOCAB))
                case _:
                    j = rng.randrange(len(w))
                    w = w[j:] + w[:j]
        out.append(" ".join(w))
    return out


def corpus(seed=1, groups=25, n=5):
    rng = random.Random(seed)
    texts = []
    for _ in range(groups):
        base = " ".join(rng.choice(VOCAB) for _ in range(rng.randint(12, 60)))
        texts += [base, *variants(rng, base, n)]
    # a phrase that all share, copies, repetitive texts and odd ones
    texts = ["the answer to this long and common question is " + t if i % 3 == 0 else t for i, t in enumerate(texts)]
    texts += [texts[0]] * 40 + ["a b c " * 20, "a b c " * 19 + "d", "x y " * 30, None, "", "   ", "short text", "ﬁne " * 15, "fine " * 15, "w1 " * 5000]
    return [(f"id{i:04d}", t) for i, t in enumerate(texts)]


def closure(ids, edges):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    groups = {}
    for i in ids:
        groups.setdefault(find(i), []).append(i)
    return {p for g in groups.values() for p in combinations(sorted(g), 2)}


@pytest.mark.parametrize("last", [0, 10**9])
def test_components_of_many_shapes(spark, last):
    rng = np.random.default_rng(3)
    ids = rng.integers(-(2**62), 2**62, 600)
    path = [(int(ids[i]), int(ids[i + 1])) for i in range(200)]
    star = [(int(ids[300]), int(ids[i])) for i in range(301, 400)]
    ring = [(int(ids[400 + i]), int(ids[400 + (i + 1) % 50])) for i in range(50)]
    edges = path + star + ring + [(int(ids[500]), int(ids[500]))] + path[:3]
    df = spark.createDataFrame(edges, "u bigint, v bigint").repartition(7)
    got = {r["node"]: r["root"] for r in C.connected_components(df, partitions=8, last_edges=last).collect()}
    assert set(got) == {x for e in edges for x in e}
    want = {frozenset({x for e in part for x in e}) for part in (path, star, ring)} | {frozenset({int(ids[500])})}
    by_root = {}
    for k, v in got.items():
        by_root.setdefault(v, set()).add(k)
    assert {frozenset(g) for g in by_root.values()} == want


def test_components_of_nothing(spark):
    assert C.connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_groups_of_keys(spark):
    good = "task_" + "0123456789" * 2
    rows = [
        ("a", ["S1", " s2 "], None, 1), ("b", ["s2"], [], 2), ("c", None, [good.upper().replace("TASK", "task")], 3), ("d", [None, ""], [" " + good + " ", "n/a"], 4), ("e", [], ["n/a", "task_"], 5),
        ("f", ["  "], [None], 6), ("a", ["S1", " s2 "], None, 7), ("g", ["zz", "zz"], None, 8), (None, ["s1"], None, 9), ("h", ["s1"], [good], 10),
    ]
    df = spark.createDataFrame(rows, "id string, skills array<string>, sources array<string>, group_id int")
    got = {(r[0], r[1]) for r in S.groups(df, "id", "skills", "sources").collect()}
    assert got == {("a", "s1"), ("b", "s1"), ("c", "s1"), ("d", "s1"), ("h", "s1"), ("e", "e"), ("f", "f"), ("g", "zz")}
    assert S.groups(df.limit(0), "id", "skills", "sources").count() == 0


def test_greedy_counts_follow_the_greedy():
    rng = random.Random(5)
    for _ in range(30):
        histogram = {rng.randint(1, 40): rng.randint(1, 30) for _ in range(8)}
        shares = {"train": 0.8, "val": 0.1, "test": 0.1}
        total = sum(k * v for k, v in histogram.items())
        order = ["train", "test", "val"]
        left = {s: Fraction(str(shares[s])) * total for s in order}
        want = {}
        for size in sorted(histogram, reverse=True):
            for _ in range(histogram[size]):
                s = max(order, key=lambda s: (left[s], -order.index(s)))
                left[s] -= size
                want[size, s] = want.get((size, s), 0) + 1
        got = {}
        for size, _, n, s in S.greedy_counts(histogram, shares):
            got[size, s] = got.get((size, s), 0) + n
        assert got == want


def test_assignment_keeps_groups_whole_and_shares(spark):
    rng = random.Random(2)
    rows = [(f"r{i}", f"g{rng.randint(0, 300) if i % 3 else 0}") for i in range(3000)]
    members = spark.createDataFrame(rows, "id string, group_id string")
    out = S.assign(members, "id", {"train": 0.8, "val": 0.1, "test": 0.1}).join(members, "id")
    assert out.count() == 3000
    assert out.groupBy("group_id").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    n = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert abs(n["train"] - 2400) <= 30 and abs(n["val"] - 300) <= 30 and abs(n["test"] - 300) <= 30
    assert S.assign(members.limit(0), "id", {"train": 1.0}).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_near_groups_equal_brute_force(spark, seed):
    rows = corpus(seed)
    sets = {i: triples(t) for i, t in rows if triples(t)}
    edges = [(a, b) for a, b in combinations(sorted(sets), 2) if jaccard(sets[a], sets[b]) >= 0.5]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows + rows[:5]], "id string, text string, cls int").repartition(5)
    members = N.near_groups(df, "id", "text", 0.5, bits=16)
    got = {(r[0], r[1]) for r in N.group_pairs(members, "id").collect()}
    assert got == closure(list(sets), edges)
    assert N.near_groups(df.limit(0), "id", "text", 0.5, bits=10).count() == 0


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 300, 60).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        sa, sb = N.sketches(a, np.array([0])), N.sketches(b, np.array([0]))
        bits = sum(bin((int(x[0]) ^ int(y[0])) & (2**64 - 1)).count("1") for x, y in zip(sa, sb))
        assert bits <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_overlaps_equal_brute_force(spark, seed):
    rows = [(i, t, None if n % 11 == 0 else n % 2 == 0) for n, (i, t) in enumerate(corpus(seed))]
    sets = {i: triples(t) for i, t, _ in rows if triples(t)}
    side = {i: s for i, _, s in rows}
    want = {(a, b) for a in sets for b in sets if side[a] is True and side[b] is False and jaccard(sets[a], sets[b]) >= 0.7}
    df = spark.createDataFrame([(*r, "x") for r in rows + rows[3:9]], "id string, text string, training boolean, seq string").repartition(4)
    out = O.cross_split(df, "id", "text", "training", 0.7, bits=16).collect()
    assert {(r["train_id"], r["eval_id"]) for r in out} == want and len(out) == len(want)
    assert all(0 < r["train_cover"] <= 1 and 0 < r["eval_cover"] <= 1 and r["similarity"] >= 0.7 for r in out)
    assert O.cross_split(df.limit(0), "id", "text", "training", bits=10).count() == 0


def test_common_triples_lose_no_pair(spark):
    """Texts mostly of one phrase, so that every window's fingerprint is too common to join on."""
    phrase = " ".join(f"p{i}" for i in range(40))
    rows = [(f"t{i}", f"{phrase} u{i} v{i}", i % 2 == 0) for i in range(90)]
    df = spark.createDataFrame(rows, "id string, text string, training boolean")
    assert O.cross_split(df, "id", "text", "training", 0.7, bits=16).count() == 45 * 45


def test_winnow_selects_every_window():
    rng = np.random.default_rng(1)
    key = rng.integers(0, 50, 200).astype(np.uint64)
    owner = np.repeat([0, 1, 2], [120, 3, 77])
    chosen = set(O.winnow(key, owner, 4).tolist())
    for o, lo, hi in ((0, 0, 120), (1, 120, 123), (2, 123, 200)):
        for i in range(lo, max(lo + 1, hi - 3)):
            window = range(i, min(i + 4, hi))
            assert {j for j in window if key[j] == min(key[k] for k in window)} <= chosen


def test_chain_and_cover():
    assert O.chain([(0, 0), (1, 5), (2, 1), (3, 2)]) == [(0, 0), (2, 1), (3, 2)]
    a, b = np.arange(10).astype(np.uint64), np.concatenate([np.arange(4), [99], np.arange(5, 10)]).astype(np.uint64)
    assert O.covered(a, b, [(1, 1), (7, 7)]) == (9, 9)
    assert O.covered(a, b, []) == (0, 0)


def test_a_cluster_of_templates_is_linear(spark):
    """Texts that differ in one number: links and candidates grow with the texts, not with their pairs."""
    base = " ".join(f"w{i}" for i in range(60))
    for n in (100, 400):
        df = spark.createDataFrame([(f"r{i:04d}", f"{base} {i} end of text number {i}") for i in range(n)], "id string, text string").repartition(4)
        _, classes = N.text_classes(df, ["id"], "text")
        links = N.stars(N.block_keys(classes)).count()
        assert n - 1 <= links <= 3 * n
        parts = N.near_components(classes, 0.5)
        assert parts.count() == n and parts.select("part").distinct().count() == 1
        levels = N.count_levels(classes.withColumn("part", F.lit(1).cast("bigint")), "part")
        assert N.candidates(N.postings(classes.withColumn("part", F.lit(1).cast("bigint")), levels, 0.5), 0.5).count() == 0


def test_pigeonhole_finds_every_close_pair(spark):
    """Pairs whose difference is below the blocks of their band always share a key."""
    rng = np.random.default_rng(4)
    rows, pairs = [], []
    for i in range(300):
        n = int(rng.integers(12, 200))
        a = rng.integers(-(2**62), 2**62, n)
        room = int(N.blocks_of(N.band_of(np.array([n])))[0]) - 1
        d = int(rng.integers(0, max(1, room // 2) + 1))
        b = np.concatenate([a[d:], rng.integers(-(2**62), 2**62, d)])
        rows += [(2 * i, n, a.tolist()), (2 * i + 1, n, b.tolist())]
        if 2 * d <= room:
            pairs.append((2 * i, 2 * i + 1))
    classes = spark.createDataFrame(rows, "cls bigint, n int, seq array<bigint>")
    keys = N.block_keys(classes).toPandas().groupby("cls")["key"].agg(set)
    assert pairs and all(keys[a] & keys[b] for a, b in pairs)
    met = {(r["a"], r["b"]) for r in N.stars(N.block_keys(classes)).collect()}
    assert all(p in met for p in pairs)


def test_collisions_make_nothing_hot(spark):
    """However small the sketch, fingerprints are joined on as before and the result is the same."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(150):
        words = [f"w{x}" for x in rng.integers(0, 5000, 40)]
        rows.append((f"a{i}", " ".join(words), True))
        words[int(rng.integers(0, 40))] = "changed"
        rows.append((f"b{i}", " ".join(words), False))
    df = spark.createDataFrame(rows, "id string, text string, training boolean")
    want = {(r["train_id"], r["eval_id"]) for r in O.cross_split(df, "id", "text", "training", 0.7).collect()}
    small = {(r["train_id"], r["eval_id"]) for r in O.cross_split(df, "id", "text", "training", 0.7, bits=4).collect()}
    assert want == small and len(want) >= 140
    _, classes = N.text_classes(df, ["id", "training"], "text")
    sided = O.shingle_rows(df, ["id", "training"], "text").withColumn("side", F.col("training").cast("int").cast("bigint"))
    shares = []
    for bits in (16, 4):
        levels = O.count_levels(sided, "side", bits)
        bound = O.HOT_LEVEL + int(np.ceil(np.log2(1 + levels.load)))
        shares.append((levels.levels >= bound).mean())
    assert shares == [0.0, 0.0]


def test_hot_join_is_whole(spark):
    from quillmill.llm.skew import join_hot

    left = spark.createDataFrame([(i, 0 if i % 3 == 0 else i, "x") for i in range(300)], "id int, k int, group_id string")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    out = join_hot(left, "k", right, "k", "n", hot_rows=50)
    assert out.count() == 300 and out.columns == ["id", "k", "group_id", "least"] and out.where("k = 0 and least <> 0").count() == 0
    assert join_hot(left.limit(0), "k", right.limit(0), "k", "n").count() == 0
