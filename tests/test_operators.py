"""Operators against plain Python: retrieval, metrics, admission, sampling, journals, scoring, tools."""

from __future__ import annotations

import math
import random
import unicodedata
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.functions import answers as A
from quillmill.functions.text import words_of
from quillmill.operators import dedup as D
from quillmill.operators import graph as K
from quillmill.operators import journal as J
from quillmill.operators import pool as L
from quillmill.operators import ranking as G
from quillmill.operators import retrieval as R
from quillmill.operators import sampling as P
from quillmill.operators import scoring as C
from quillmill.operators import settings as O
from quillmill.operators import tools as X

DOCS = [("d1", "red fox jumps over red log"), ("d2", "lazy dog sleeps"), ("d3", "red dog barks at the fox"), ("d4", ""), ("d5", None), ("d6", "log log log")]
QUERIES = [("q1", "red fox fox"), ("q2", "dog"), ("q3", "unknown words"), ("q4", None)]


def frames(spark):
    return spark.createDataFrame(QUERIES, "qid string, text string"), spark.createDataFrame(DOCS, "did string, text string")


def test_bm25_equals_formula(spark):
    q, d = frames(spark)
    docs = {i: t.split() for i, t in DOCS if t is not None}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    want = {}
    for qi, qt in QUERIES:
        for di, words in docs.items():
            s = 0.0
            for term in set((qt or "").split()):
                df = sum(term in w for w in docs.values())
                tf = words.count(term)
                if df and tf:
                    s += max(0.0, math.log((n - df + 0.5) / (df + 0.5))) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / avg))
            if s > 0:
                want[qi, di] = s
    got = {(r["query_id"], r["item_id"]): r["score"] for r in R.bm25_scores(q, d, "qid", "text", "did", "text").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert R.bm25_scores(q, d.limit(0), "qid", "text", "did", "text").count() == 0
    flat = lambda df: sorted((r["query_id"], r["rank"], r["item_id"], round(r["score"], 9)) for r in df.collect())
    for bound in (10**6, 0):  # by broadcast, and joined by term
        for k in (1, 3):
            assert flat(R.catalog_top_k(q, d, "qid", "text", "did", "text", k, bound=bound)) == flat(R.top_k(R.bm25_scores(q, d, "qid", "text", "did", "text"), k))
    assert R.catalog_top_k(q, d.limit(0), "qid", "text", "did", "text", 2).count() == 0 and R.catalog_top_k(q.limit(0), d, "qid", "text", "did", "text", 2).count() == 0


def test_blocks_equal_the_term_join(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(words[: rng.randint(2, 60)]) for _ in range(n))
    docs = spark.createDataFrame([(i, text(rng.randint(0, 30))) for i in range(300)] + [(900, None), (901, "")], "did bigint, text string").repartition(4)
    queries = spark.createDataFrame([(f"q{i}", text(6)) for i in range(25)] + [("none", None), ("odd", "zzz")], "qid string, text string")
    flat = lambda df: sorted((r["query_id"], r["rank"], r["item_id"], round(r["score"], 9)) for r in df.collect())
    want = flat(R.top_k(R.bm25_scores(queries, docs, "qid", "text", "did", "text"), 5))
    for block in (4096, 7):
        assert flat(R.bm25_top_k(queries, docs, "qid", "text", "did", "text", 5, block=block)) == want and want
    assert R.bm25_top_k(queries, docs.limit(0), "qid", "text", "did", "text", 5).count() == 0
    assert R.bm25_top_k(queries.limit(0), docs, "qid", "text", "did", "text", 5).count() == 0


def test_tfidf_equals_formula(spark):
    q, d = frames(spark)
    docs = {i: t.split() for i, t in DOCS if t is not None}
    vocab = {w for t in docs.values() for w in t}
    idf = {w: math.log(len(docs) / (1 + sum(w in t for t in docs.values()))) for w in vocab}

    def vector(words):
        known = [w for w in words if w in vocab]
        v = {w: known.count(w) / len(known) * idf[w] for w in known}
        n = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {w: x / n for w, x in v.items()}

    got = {(r["query_id"], r["item_id"]): r["score"] for r in R.tfidf_scores(q, d, "qid", "text", "did", "text").collect()}
    for (qi, di), s in got.items():
        a, b = vector(dict(QUERIES)[qi].split()), vector(docs[di])
        assert abs(s - sum(a[w] * b.get(w, 0) for w in a)) < 1e-12
    assert {k for k in got} == {("q1", "d1"), ("q1", "d3"), ("q2", "d2"), ("q2", "d3")}


def test_dense_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    rows = [(i, [float(x) for x in v[i]]) for i in range(60)] + [(100, None), (101, [0.0] * 8)]
    df = spark.createDataFrame(rows, "id bigint, v array<float>").repartition(5)
    unit = v.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for block in (4096, 2):
        got = {}
        for r in R.dense_top_k(df.where("id < 6"), df, "id", "v", "id", "v", 3, block=block).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["item_id"]))
        for q in range(6):
            s = np.round(unit @ unit[q], 9)
            s[q] = -9
            assert [i for _, i in sorted(got[q])] == sorted(range(60), key=lambda i: (-s[i], i))[:3]


def test_fusion_and_metrics(spark):
    make = lambda rows: spark.createDataFrame(rows, "query_id string, rank int, item_id string, score double")
    a = make([("q", 1, "x", 0.9), ("q", 2, "y", 0.8), ("only_a", 1, "x", 1.0)])
    b = make([("q", 1, "y", 0.7), ("q", 2, "z", 0.6), ("q", 3, "x", 0.1), ("only_b", 1, "x", 1.0)])
    got = [(r["rank"], r["item_id"], r["score"]) for r in R.round_robin(a, b, 3).orderBy("rank").collect()]
    assert got == [(1, "x", 0.9), (2, "y", 0.7), (3, "z", 0.6)]
    gold = spark.createDataFrame([("q", "y"), ("q", "w"), ("none", None)], "query_id string, item_id string")
    m = {r["metric"]: r["value"] for r in R.retrieval_metrics(b, gold, 5).collect()}
    assert m["Recall@1"] == pytest.approx(0.25) and m["Recall@5"] == pytest.approx(0.25)
    assert m["nDCG@5"] == pytest.approx(0.5 / (1 + 1 / math.log2(3)))
    with pytest.raises(ValueError):
        R.retrieval_metrics(b, gold, 0)


def test_distractors_take_turns(spark):
    make = lambda rows: spark.createDataFrame(rows, "query_id string, rank int, item_id string")
    gold = spark.createDataFrame([("q", "g")], "query_id string, item_id string")
    lex, sem = make([("q", 1, "g"), ("q", 2, "a"), ("q", 3, "b")]), make([("q", 1, "a"), ("q", 2, "c")])
    got = [r["item_id"] for r in R.distractors(gold, lex, sem, 9).orderBy("pos").collect()]
    assert got == ["a", "c", "b"]


def test_admission_equals_sequential_pass(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta"]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(14)]
        for i in range(6):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(14)] = rng.choice(words)
            rows.append((f"{len(rows):03d}", f"s{g % 3}", " ".join(w) + (f" {g % 2}" if i % 2 else "")))
    rows += [("900", "s0", None), ("901", "s0", "too short"), ("902", "s0", "too  SHORT"), ("903", "s1", "too short")]
    want = set()
    for key in ("s0", "s1", "s2"):
        seen = []
        for i, k, t in sorted(rows):
            n = " ".join(words_of(t))
            if k != key or not n or n in seen:
                continue
            numbers = [x for x in n.split() if x.isdigit()]
            if len(n.split()) >= 12 and any(len(p.split()) >= 12 and [x for x in p.split() if x.isdigit()] == numbers and SequenceMatcher(None, n, p, autojunk=False).ratio() >= 0.88 for p in seen):
                continue
            seen.append(n)
            want.add(i)
    df = spark.createDataFrame(rows, "id string, key string, text string").repartition(3)
    assert {r["id"] for r in D.near_admission(df, "key", "id", "text").collect()} == want
    firsts = df.where(df["id"].isin(sorted(want)[:2])).select("key", "text")
    seeded = {r["id"] for r in D.near_admission(df, "key", "id", "text", existing=firsts).collect()}
    assert not seeded & set(sorted(want)[:2])
    assert {r["id"] for r in D.near_admission(df, "key", "id", "text", existing=firsts.limit(0)).collect()} == want


def test_prefix_filter_agrees(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 25))) for _ in range(60)]
    near = [" ".join(t.split()[:-1] + ["z"]) for t in texts[:30]]
    a = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None), (98, "")], "id int, text string")
    b = spark.createDataFrame([(i, t) for i, t in enumerate(near + texts[:5])], "id int, text string")
    for t in (0.3, 0.6, 0.92):
        x = {tuple(r) for r in D.near_overlap(a, b, "id", "text", "id", "text", t).collect()}
        y = {tuple(r) for r in D.near_overlap_prefix(a, b, "id", "text", "id", "text", t).collect()}
        assert x == y and x
    once, blocked = D.decontaminate(b, a, b.limit(0), "id", "text", "id", "text", 0.6)
    again, more = D.decontaminate(once, a, blocked, "id", "text", "id", "text", 0.6)
    assert again.count() == once.count() and more.count() == blocked.count()


def test_hash_rank_is_one_order(spark):
    rows = [(f"i{i}", "hot" if i % 3 else f"k{i}", 1) for i in range(2000)] + [("n1", None, 1), ("n2", None, 1)]
    df = spark.createDataFrame(rows, "id string, key string, rank int").drop("rank").repartition(6)
    out = G.hash_rank(df, F.col("key"), 5, F.col("id")).withColumn("o", G.hash_order(5, F.col("id"))).collect()
    by = {}
    for r in out:
        by.setdefault(r["key"], []).append((r["rank"], r["o"]))
    for v in by.values():
        v.sort()
        assert [x[0] for x in v] == list(range(1, len(v) + 1)) and [x[1] for x in v] == sorted(x[1] for x in v)
    assert len(out) == 2002 and G.hash_rank(df.limit(0), F.col("key"), 5, F.col("id")).count() == 0


def test_nested_budgets_share_validation(spark):
    df = spark.createDataFrame([(f"i{i}",) for i in range(100)], "id string")
    parts = [{(r["id"], r["part"]) for r in P.train_val_split(df, F.lit("s"), "id", 1, n, 50, 10).collect()} for n in (10, 20, 50)]
    train = [{i for i, p in x if p == "train"} for x in parts]
    assert train[0] < train[1] < train[2] and list(map(len, train)) == [10, 20, 50]
    assert len({frozenset(i for i, p in x if p == "val") for x in parts}) == 1
    with pytest.raises(ValueError):
        P.train_val_split(df, F.lit("s"), "id", 1, 60, 50, 10)


def test_shards_reassemble(spark):
    df = spark.createDataFrame([(f"i{i}",) for i in range(101)], "id string")
    for n in (1, 2, 4):
        sizes = [r["count"] for r in P.stride_shard(df, "id", 1, n).groupBy("shard").count().collect()]
        assert sum(sizes) == 101 and max(sizes) - min(sizes) <= 1
    assert P.balanced_shards({"a": 5, "b": 3, "c": 3}, ["x"], 2) == {"a": 0, "b": 1, "c": 1, "x": 0}


def test_anchors_are_negatives(spark):
    ranked = spark.createDataFrame([(f"q{i}", r, f"s{(i + r) % 5}") for i in range(40) for r in (1, 2, 3)], "query_id string, rank int, item_id string")
    gold = spark.createDataFrame([(f"q{i}", f"s{(i + 1) % 5}") for i in range(40)], "query_id string, item_id string")
    skills = spark.createDataFrame([(f"s{i}",) for i in range(6)], "skill_id string")
    out = P.anchors(ranked, gold, skills, 3, 4, 1.5, 1)
    own = gold.withColumnRenamed("item_id", "skill_id")
    assert out.join(own, ["query_id", "skill_id"]).count() == 0
    n = {(r["skill_id"], r["kind"]): r["count"] for r in out.groupBy("skill_id", "kind").count().collect()}
    assert all(n[f"s{i}", "near"] == 5 for i in range(5)) and all(n[f"s{i}", "random"] == 4 for i in range(6))
    ranks = ranked.select("query_id", F.col("item_id").alias("skill_id"))
    assert out.where("kind = 'random'").join(ranks, ["query_id", "skill_id"]).count() == 0


def test_journals(spark):
    rows = [("a", 1, 1, "ok"), ("a", 2, 2, "bad"), ("a", 2, 3, "ok"), ("b", 0, 4, "ok"), ("c", 1, 5, "odd"), ("d", 3, 6, "bad")]
    j = spark.createDataFrame(rows, "key string, attempt int, line int, status string")
    got = {r["key"]: (r["attempt"], r["line"]) for r in J.latest_attempt(j, "key", "attempt", "line", ["ok", "bad"]).collect()}
    assert got == {"a": (2, 3), "d": (3, 6)}
    ok = F.when(F.col("status") == "odd", None).otherwise(F.col("status") == "ok")
    assert {r["key"]: r["line"] for r in J.resume(j, "key", "line", ok).collect()} == {"a": 1, "b": 4}


def test_pool_functions(spark):
    rows = [("b", "Same  question", ["s2", ""], 1), ("a", "same question!", ["s1", None], 2), ("c", "", ["s3"], 3), ("d", None, None, 4)]
    df = spark.createDataFrame(rows, "id string, q string, gold array<string>, members int")
    assert [tuple(r) for r in L.merge_questions(df.drop("members"), "id", "q", ["gold"]).select("id", "members", "gold").collect()] == [("a", 2, ["s1", "s2"])]
    cover = {r["violation"]: r["n"] for r in L.exact_cover(spark.createDataFrame([("a",), ("a",), ("z",)], "id string"), df, "id").collect()}
    assert cover == {"missing": 3, "unexpected": 1, "repeated": 1}
    assert [r["n"] for r in L.difference(df, df, "id").collect()] == [0, 0]


def score(spark, f, rows, schema="x string, g string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(f.alias("v")).collect()]


def test_number_parsing(spark):
    rows = [("1",), (" -2.5 ",), ("1/4",), ("1e3",), ("inf",), ("nan",), ("1_0",), ("1d",), ("",), (None,), ("1/0",), ("x",)]
    assert score(spark, A.number(F.col("x")), rows, "x string") == [1.0, -2.5, 0.25, 1000.0, None, None, None, None, None, None, None, None]


def test_extractors(spark):
    x = F.col("x")
    assert score(spark, A.after_trigger(x), [("The answer is: a. The answer is: b/.\nmore", ""), ("none", ""), (None, "")]) == ["b", None, None]
    assert score(spark, A.toolqa_extract(x), [("Finish[a] Finish[ b ]", ""), ("so the answer is: 7.", ""), ("l1\n\n last \n", ""), ("", "")]) == ["b", "7", "last", ""]
    bqa = [("the answer is **No**. answer is yes", ""), ("Yes, it is", ""), ("we cannot conclude that", ""), ("maybe yes or no", ""), ("it is true", ""), ("line\nLast One", "")]
    assert score(spark, A.bqa_extract(x), bqa) == ["yes", "yes", "no", "no", "yes", "last one"]
    q = "Which? choice_1: the cat sat, choice_2: a dog\nchoice_3: birds"
    mcqa = [("choice 2 or choice_3", q), ("the answer is 1", q), ("surely a dog", q), ("x\nmaybe 4", q), ("no idea", q)]
    assert score(spark, A.mcqa_extract(x, F.col("g")), mcqa) == ["choice_3", "choice_1", "choice_2", "choice_4", "no idea"]
    med = A.medcalc_extract(x, F.lit("decimal"), F.lit(2))
    assert score(spark, med, [("a\nanswer: **5.2**", ""), ('{"answer": "7"}', ""), ("the answer is: 3.", ""), ("from 1 to -2.5", ""), ("words\nonly", "")]) == ["5.2", "7", "3", "-2.5", "only"]
    assert score(spark, A.medcalc_extract(x, F.lit("date"), F.lit(13)), [("due 3/7/2024", "")]) == ["03/07/2024"]
    assert score(spark, A.medcalc_extract(x, F.lit(None).cast("string"), F.lit(69)), [("28 weeks 4 days", "")]) == ["(28, 4)"]


def test_medcalc_scoring(spark):
    rows = [("2.5", "2", 4, None, None), ("3.5", "4", 4, None, None), ("12/31/2024", "12/31/2024", 13, None, None), ("2/30/2024", "2/30/2024", 13, None, None), ("(28, 4)", "28 weeks, 4 days", 69, None, None),
            ("1/3", "0.33", 2, "0.3", "0.35"), ("inf", "1", 2, "0", "9"), ("5", "5", 2, "", ""), (None, "1", 2, "0", "9")]
    f = A.medcalc_correct(F.col("x"), F.col("g"), F.col("c"), F.lit(None).cast("string"), F.col("l"), F.col("u"))
    assert score(spark, f, rows, "x string, g string, c int, l string, u string") == [True, True, True, False, True, True, False, False, False]


def test_theorem_answers():
    assert A.theorem_extract("so true") == "True" and A.theorem_extract("The answer is: x = 3.5 m.") == "3.5" and A.theorem_extract("about 1 and 27") == "27"
    assert A.theorem_extract("Therefore, the answer is (b).") == "(b)" and A.theorem_extract("") == ""
    assert A.theorem_correct("3.2", "3.1", "float") and not A.theorem_correct("3.3", "3.1", "float") and A.theorem_correct("2.5", "2", "integer")
    assert A.theorem_correct("(3, 1)", "[1, 3]", "list of integer") and not A.theorem_correct("[1]", "[1, 3]", "list of integer")
    assert not A.theorem_correct("[3, 1]", "[1, 3]", "list of integer") and not A.theorem_correct("0.5", "1/2", "float") and A.theorem_correct("1/2", "0.5", "float")
    assert A.theorem_extract("The answer is 7.") == "7" and A.theorem_extract("no, but yes") == "True" and A.theorem_correct("(1, 2.02)", "(1, 2.0)", "list of float")
    assert A.theorem_correct("option (C)", "(c)", "option") and A.theorem_number("\\frac{1}{4}") == 0.25 and A.theorem_number("50%") == 0.5
    for bad in ("__import__('os')", "2**2**40", "9" * 400 + "**99", "a.b", "[1 for x in y]", "factorial(99999)", "("):
        assert A.arithmetic(bad) is None
    assert A.arithmetic("2^3 + sqrt(16)/2") == 10 and A.calculate_text("7/2") == "3.5" and A.calculate_text("6/2") == "3"


def test_calculator_lists(spark):
    rows = [("mean(1, 2, nan, 4)",), ("MEDIAN(3,1,2,10)",), ("sum(0.1,0.2)",), ("max(1,-2)",), ("min()",), ("mean(nan)",), ("1+1",)]
    assert score(spark, A.calculate(F.col("x")), rows, "x string") == [2.333, 2.5, 0.3, 1.0, None, None, None]


def test_scores(spark):
    df = spark.createDataFrame([("a", True), ("a", None), ("b", False)], "k string, correct boolean")
    assert {r["k"]: (r["correct"], r["total"], r["accuracy"]) for r in C.accuracy(df, "k").collect()} == {"a": (1, 2, 0.5), "b": (0, 1, 0.0)}
    e = spark.createDataFrame([(1, 0.70, 64), (2, 0.74, 64), (3, 0.75, 64), (4, float("nan"), 64), (5, 0.75, 64)], "epoch int, acc double, n int")
    r = C.one_standard_error(e, "epoch", "acc", "n").first()
    assert (r["best_epoch"], r["chosen"]) == (3, 1)
    assert math.isnan(C.weighted_mean(df.limit(0).withColumn("v", F.lit(1.0)).withColumn("w", F.lit(1)), "v", "w").first()["mean"])


def test_filter_session(spark):
    t = spark.createDataFrame([("1", "9", "x, y"), ("2", "10", None), ("3", "7", "z")], "id string, n string, s string")
    s = X.ToolSession(spark, {"t": t})
    assert s.act("FilterDB[n=1]") == "No table is loaded." and "id, n, s" in s.act("LoadDB[t]")
    s.act("FilterDB[n>10]")
    assert s.data.count() == 2  # compared as text
    s.act("FilterDB[s='z', id=9]")
    assert s.data.count() == 2  # an empty result restores the state before the call
    s.act("FilterDB[s='z', nothing=1]")
    assert s.act("GetValue[n]") == "7"  # an error keeps what came before it
    assert s.act("FilterDB[no operator]").startswith("Filtered")
    assert s.act("SQLInterpreter[select id from u.t_data where n = '9']") == "id: 1"
    assert "Only queries" in s.act("SQLInterpreter[insert into t_data values (1)]") and "failed" in s.act("SQLInterpreter[select nope from t_data]")
    assert s.act("Finish[a]; Finish[b]") == "Only one action at a time." and s.act("") == "The action is empty." and "no action" in s.act("Fly[x]")


def test_graph(spark):
    v = spark.createDataFrame([("1", "a", "o"), ("2", "b", None), ("3", "c", "o"), ("4", "d", "o")], "id string, name string, org string")
    e = spark.createDataFrame([("1", "2", ["3", "4"]), ("3", "1", [])], "src string, dst string, items array<string>")
    names = spark.createDataFrame([("a",), ("zz",)], "name string")
    assert {(r[0], r[1]) for r in K.neighbours(e, v, names).collect()} == {("a", "b"), ("a", "c")}
    pairs = spark.createDataFrame([("b", "a"), ("a", "d"), ("a", "c")], "a string, b string")
    assert {(r["a"], r["b"]): r["items"] for r in K.edge(e, v, pairs).collect()} == {("b", "a"): "c, d", ("a", "d"): None, ("a", "c"): None}
    assert {r["id"] for r in K.usable_vertices(e, v, "org is not null").collect()} == {"1", "3"}


def test_settings(spark):
    s = spark.createDataFrame([("defaults", None, "k", "1"), ("model", "m", "k", "2"), ("skill", "s", "k", "3"), ("flags", None, "z", "9")], "scope string, name string, key string, value string")
    t = spark.createDataFrame([("m", "d", "s"), ("m", "d", "t"), ("n", "d", "t")], "model string, dataset string, skill_id string")
    got = {(r["model"], r["skill_id"], r["key"]): r["value"] for r in O.resolve(s, t).collect()}
    assert got == {("m", "s", "k"): "3", ("m", "t", "k"): "2", ("n", "t", "k"): "1", ("m", "s", "z"): "9", ("m", "t", "z"): "9", ("n", "t", "z"): "9"}


def test_copies_in_other_unicode_forms(spark):
    from quillmill.operators import audit as U
    from quillmill.operators import selection as N

    plain = "Where is the café of the old ﬁsh market in Zürich ②"
    forms = [plain, unicodedata.normalize("NFD", plain), unicodedata.normalize("NFKC", plain), "Ｗhere is the café of the old fish market in zürich 2"]
    assert len({" ".join(words_of(t)) for t in forms}) == 1
    a = spark.createDataFrame([(i, t, [f"s{i}"]) for i, t in enumerate([*forms, "something else altogether that is long enough", None, " "])], "id int, text string, gold array<string>")
    test = spark.createDataFrame([(90, forms[1])], "id int, text string")
    ids = lambda df: sorted(r["id"] for r in df.select("id").collect())
    assert ids(D.exact_dedup(a, "text", "id")) == [0, 4]
    assert {tuple(r) for r in D.overlapping(a, test, "id", "text", "id", "text").collect()} == {(i, "exact") for i in range(4)}
    for f in (D.near_overlap, D.near_overlap_prefix):
        assert {tuple(r) for r in f(test, a, "id", "text", "id", "text").collect()} == {(90, i, 1.0) for i in range(4)}
    assert ids(D.decontaminate(a, test, a.limit(0), "id", "text", "id", "text")[0]) == [4, 5, 6]
    assert ids(D.exclude_near(a, test, "id", "text")) == [4, 5, 6]
    assert ids(N.exclude_held_out(a, test, "text", "text")) == [4, 5, 6]
    assert [r["members"] for r in L.merge_questions(a, "id", "text", ["gold"]).orderBy("id").collect()] == [4, 1]
    paths = a.withColumn("path", F.lit("p"))
    assert ids(D.duplicate_issues(paths, "path", "id", "text")) == [1, 2, 3]
    skills = a.select(F.explode("gold").alias("skill_id"), F.lit("x").alias("name"))
    audit = U.leakage(a, skills, "id", "text", "gold", D.overlapping(a, test, "id", "text", "id", "text"))
    assert audit.where("issue = 'exact_test_question_overlap'").count() == 4 and audit.where("issue = 'duplicate_normalized_question'").count() == 1


def replies(spark, folder):
    """Tables of one reply that is right and one that is wrong for every dataset."""
    data = "answer string, answer_type string, task_type string, output_type string, calculator_id int, lower_limit string, upper_limit string"
    ask = [
        ("t", "theoremqa", "q", ("2.5", "float", None, None, None, None, None), "The answer is 2.5", "The answer is 7"),
        ("l", "logicbench", "q", ("yes", None, "BQA", None, None, None, None), "Answer: yes", "Answer: no"),
        ("o", "toolqa", "q", ("Oslo", None, None, None, None, None, None), "Finish[Oslo]", "Finish[Bergen]"),
        ("m", "medcalcbench", "q", ("10.0", None, None, "decimal", 2, "9.5", "10.5"), "Answer: 10.1", "Answer: 30"),
    ]
    spark.createDataFrame([a[:4] for a in ask], f"instance_id string, dataset string, question string, eval_data struct<{data.replace(' string', ':string').replace(' int', ':int')}>").write.parquet(f"{folder}/example_instance.parquet")
    rows = [(10 * i + k, a[0], "m", "x", a[4 + k], None, (False,)) for i, a in enumerate(ask) for k in (0, 1)]
    spark.createDataFrame(rows, "record_id bigint, instance_id string, method string, model string, raw_output string, error string, meta struct<failed:boolean>").write.parquet(f"{folder}/inference_record.parquet")
    return {r[0]: r[0] % 10 == 0 for r in rows}


def test_accuracy_of_all_datasets(spark, tmp_path):
    import __spark_entry__ as e

    replies(spark, tmp_path)
    got = {r["dataset"]: (r["correct"], r["total"], r["accuracy"]) for r in e.queries()["accuracy_all"](spark, str(tmp_path)).collect()}
    assert got == dict.fromkeys(("theoremqa", "logicbench", "toolqa", "medcalcbench"), (1, 2, 0.5))


def test_comparison_of_all_datasets(spark, tmp_path):
    import __spark_entry__ as e

    want = replies(spark, tmp_path)
    assert {r["record_id"]: r["same"] for r in e.queries()["compare_all"](spark, str(tmp_path)).collect()} == want
    empty = spark.createDataFrame([("theoremqa", "", "q"), ("theoremqa", None, "q")], "dataset string, r string, question string")
    assert [r["same"] for r in C.compared(empty, "r", F.lit(" "), "dataset", "question").collect()] == [False, False]
