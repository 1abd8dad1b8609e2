"""Encoding, packing, leakage, stuffed pages and broken pairs: exactness, held-out accuracy and edge cases."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.functions.text import words_of
from quillmill.llm import leakage as L
from quillmill.llm import pairs as P
from quillmill.llm import spam as W
from quillmill.llm.crf import Crf, Sequences
from quillmill.llm.encode import Encoder, count_tokens, encode
from quillmill.llm.packing import pack, plan, split_items
from quillmill.llm.vocab import DEFAULT_VOCAB, load_ranks, merge_exact

ODD = ["", " ", "  a", "a  b\n\n c \t", "x\x1c\x1dy", "a\x85b \x85 c", "　　a", "I'LL don't we're 'tis 's's", "<|endoftext|> hi", "a" * 3000, "👩‍🔬🧪 ok", "ſtraße İstanbul",
       "​﻿ x", "1²3½ ⅷ", "naïve café", "\x00\x01", "abc   ", "\n\n\n", " \n x", "x \n", "日本語テキスト 한국어", "a b", "...  !!!\t\t?", "᠎ a", "é" * 700, " " * 2000]


@pytest.fixture(scope="module")
def ranks():
    return load_ranks(DEFAULT_VOCAB)


def reference(ranks):
    tiktoken = pytest.importorskip("tiktoken")
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_encoder_equals_public_library(ranks):
    own, ref = Encoder(ranks), reference(ranks)
    ids, n = own.encode(ODD)
    at = np.concatenate(([0], np.cumsum(n)))
    for i, t in enumerate(ODD):
        assert ids[at[i] : at[i + 1]].tolist() == ref.encode_ordinary(t), repr(t)
    assert own.merged > 0 and own.count(ODD).tolist() == n.tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_encoder_on_any_text(text):
    own = _shared()
    ids, n = own.encode([text])
    assert ids.tolist() == own.reference.encode_ordinary(text)
    assert b"".join(own.tokens[i] for i in ids.tolist()) == text.encode()


_own = []


def _shared():
    if not _own:
        ranks = load_ranks(DEFAULT_VOCAB)
        _own.append(Encoder(ranks))
        _own[0].reference = reference(ranks)
    return _own[0]


def test_merging_of_long_words(ranks):
    ref = reference(ranks)
    for w in (b"a" * 5000, b"abcabcabd" * 400, bytes(range(33, 127)) * 20):
        assert merge_exact(w, ranks) == ref._encode_single_piece(w)


def test_encode_keeps_rows(spark):
    rows = [(1, "hi there", "en"), (2, None, "x"), (3, "", None), (1, "hi there", "en"), (None, "a", "b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string").repartition(3)
    got = sorted(((r["doc_id"], tuple(r["ids"])) for r in encode(df, "doc_id", "text").collect()), key=str)
    assert len(got) == 5 and (2, ()) in got and (3, ()) in got and got.count((1, got[[g[0] for g in got].index(1)][1])) == 2
    n = {r["doc_id"]: r["tokens"] for r in count_tokens(df, "doc_id", "text").collect()}
    assert n == {1: 2, 2: 0, 3: 0, None: 1}
    assert encode(df.limit(0), "doc_id", "text").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_plan_places_every_item_once(histogram):
    runs, used = plan(histogram, 64)
    room, seen = [64] * used, {}
    for size, rank, n, first in runs:
        for i in range(n):
            room[first + i] -= size
            assert (size, rank + i) not in seen
            seen[size, rank + i] = first + i
    assert min(room, default=0) >= 0 and len(seen) == sum(histogram.values())
    total = sum(k * v for k, v in histogram.items())
    assert used <= 2 * total / 64 + 1  # no two containers could be one


def test_packing_is_whole(spark):
    rng = random.Random(4)
    rows = [(i, 7 if i % 3 == 0 else rng.randint(0, 300)) for i in range(2000)] + [(9001, None), (9002, 100), (9003, 200), (9004, 101)]
    sizes = spark.createDataFrame([(*r, 1) for r in rows], "id bigint, tokens bigint, size int").repartition(5)
    out = pack(sizes, "id", "tokens", 100).collect()
    by_item, by_container = {}, {}
    for r in out:
        by_item.setdefault(r["id"], []).append((r["piece"], r["begin"], r["size"]))
        by_container[r["container"]] = by_container.get(r["container"], 0) + r["size"]
    assert max(by_container.values()) <= 100 and sorted(by_container) == list(range(len(by_container)))
    for i, n in rows:
        parts = sorted(by_item.get(i, []))
        assert sum(p[2] for p in parts) == (n or 0) and len(parts) == -(-(n or 0) // 100)
        assert all(p[1] == sum(q[2] for q in parts[:k]) for k, p in enumerate(parts))
    split = {r["id"] for r in split_items(pack(sizes, "id", "tokens", 100), "id").collect()}
    assert split == {i for i, n in rows if (n or 0) > 100}
    assert pack(sizes.limit(0), "id", "tokens", 100).count() == 0


def triples(t):
    w = words_of(t)
    return set(zip(w, w[1:], w[2:]))


def test_leaks_equal_brute_force(spark):
    rng = random.Random(6)
    vocab = [f"v{i}" for i in range(120)]
    tests = [(f"t{i}", " ".join(rng.choice(vocab) for _ in range(rng.randint(3, 40)))) for i in range(30)] + [("none", None), ("short", "v1 v2"), ("twice", "v1 v2 v3 " * 6)]
    docs = []
    for i in range(200):
        t = rng.choice(tests[:30])[1].split()
        k = rng.randrange(len(t))
        part = t[k:] + ["x"] + t[:k] if i % 3 == 0 else t[: rng.randint(1, len(t))]
        filler = [rng.choice(vocab) for _ in range(rng.randint(0, 200))]
        docs.append((i, " ".join(filler + part + filler[:5])))
    docs += [(500, None), (501, ""), (502, "V1, v2! v3 " * 400), (503, docs[0][1])]
    want = {(i, n) for i, d in docs for n, t in tests if t and triples(t) and len(triples(t) & triples(d)) * 2 >= len(triples(t))}
    corpus = spark.createDataFrame([(*d, "q") for d in docs], "id bigint, text string, triples string").repartition(3)
    known = spark.createDataFrame([(*t, 1) for t in tests], "test string, question string, id int")
    for limit in (10**6, 0):  # joined by broadcast, and by a shuffle of split keys
        out = L.leaked(corpus, known, ["id"], "text", "test", "question", broadcast_rows=limit).collect()
        assert {(r["id"], r["test"]) for r in out} == want and len(out) == len(want)
    assert L.leaked(corpus, known.limit(0), ["id"], "text", "test", "question").count() == 0
    assert L.leaked(corpus.limit(0), known, ["id"], "text", "test", "question").count() == 0


def test_templated_tests_make_no_false_seeds(spark):
    """A phrase that many tests share, in many texts: no seeds, unless it is half of a test."""
    phrase = " ".join(f"p{i}" for i in range(10))
    tests = [(f"t{i}", phrase + " " + " ".join(f"x{i}_{j}" for j in range(20))) for i in range(200)]
    known = spark.createDataFrame(tests, "test string, question string")
    rows = L.shingle_rows(known, ["test"], "question", min_words=3)
    shown = L.shown_triples(rows.select("cls", "n", "seq"), 0.5)
    n = shown.count()
    corpus = spark.createDataFrame([(i, f"start {phrase} end {i}") for i in range(50)] + [(99, tests[7][1])], "id bigint, text string")
    texts = L.candidate_texts(corpus, ["id"], "text", L.tables(rows.select("cls", "n", "seq"), shown, n, 0.5))
    assert texts.count() == 1 and L.seed_pairs(texts, shown.select("triple", "test"), n).count() <= 5
    assert [(r["id"], r["test"]) for r in L.leaked(corpus, known, ["id"], "text", "test", "question").collect()] == [(99, "t7")]


def test_tiles_are_longest_first_and_disjoint():
    a, b = np.array([1, 2, 3, 4, 9, 1, 2]), np.array([1, 2, 8, 1, 2, 3, 4])
    starts = [(i, j) for i in range(7) for j in range(7) if a[i] == b[j]]
    assert L.tiles(a, b, starts) == [(0, 3, 4), (5, 0, 2)]


PROSE = "We walked to the old mill because the road was closed, and nobody knew when it would open again. The water had risen in the night. "
STUFFED = {
    "phrases": "cheap shoes online | best shoes near me | " * 20,
    "tags": "#sale #shoes #red #new #slim #cotton " * 12,
    "links": "\n".join(f"* http://shop{i}.example/item/{i}" for i in range(30)),
    "anchors": "\n".join(f"* [red shoe](https://shop{i}.test/a)" for i in range(30)),
    "products": "\n".join(f"Velmo shoe {i} | red | slim | ${i}.99 | SKU AB-{i}" for i in range(30)),
    "enumeration": ", ".join(["lattice", "anemia", "bakery", "queue", "stroke", "kernel", "taqueria", "albumin"] * 8),
    "lines": "\n".join(["random walk", "blood pressure", "noodle bar", "linear map", "sleep apnea", "wine cellar"] * 8),
    "doorway": "\n".join(f"bmi tool in {c}ville\nloan helper in {c}ton" for c in ["Al", "Be", "Cor", "Del", "Es", "Fin", "Gor"]),
    "sentences": "Best shoe shop. Cheap shoe shop, shoe shop red! " * 15,
}
CLEAN = {
    "prose": PROSE * 8,
    "german": "Zuerst teilen wir die Pumpe durch 25 und erhalten damit 48. Es gibt außerdem eine Lieferung, die er am Abend öffnet. " * 6,
    "code": "```python\ndef f(x):\n    return x / 3\n\nfor i in range(9):\n    print(f(i))\n```",
    "table": "item | value\nglucose | 58.6\nalbumin | 87.4\nferritin | 94.0\ncalcium | 45.2",
    "mixed": PROSE * 8 + "Tags: lever, garden, beacon, quarry, corridor",
    "references": PROSE * 4 + "References\n[1] A. Able and B. Baker, “On walking to the mill”, 2019, see https://a.example/x.",
}


FRAMES = [
    "We saw the {} of the {} because it was in the {}, and nobody had it.", "They {} to the {} when it would {}, but it was not for the {}.", "It is the {} that you have in a {}, so we are on the {}.",
    "If the {} was in the {}, then he had to {} it for the {}.", "She had a {} and it was on the {} in the {}.", "The {} is not a {}, and the {} that we have is of the {}.", "There is a {} in the {}, so that they {} it to the {}.",
]
NOUNS = "mill road water night boat river price market sale shoes bags shop corner street years page end house tool kinds links use shoe red cheap best online near me buy free flights deals hotel paris rome rise open walk knew".split() + [f"{a}{b}" for a in "bal cor dem fil gar hon lum nor pel ruv sat tor".split() for b in "an el ik om ur et as is on er ade ine".split()]


def prose(rng, n):
    return " ".join(f.format(*rng.choices(NOUNS, k=4)) for f in rng.choices(FRAMES, k=n))


GERMAN_PARTS = ["wir sehen die {}", "weil es in der {} ist", "es gibt eine {}", "die er mit dem {} hat", "und nicht die {}", "damit wir durch die {} gehen", "er kam am {} nach Hause", "wir haben das auch durch {} erhalten", "die {} gibt es außerdem", "zuerst war eine {} da", "und am Abend kam die {}"]


FOREIGN_PROSE = {
    "dutch": "Ik kwam thuis, ik zag de kat, ik gaf haar melk, en daarna ging ik slapen omdat ik erg moe was van de lange dag.",
    "russian": "Мы пошли к старой мельнице, потому что дорога была закрыта, и никто не знал, когда она снова откроется, а вода поднялась ночью.",
    "polish": "Poszliśmy do starego młyna, ponieważ droga była zamknięta, i nikt nie wiedział, kiedy znowu zostanie otwarta, a woda podniosła się w nocy.",
    "italian": "Siamo andati al vecchio mulino perché la strada era chiusa, e nessuno sapeva quando sarebbe stata riaperta, e l'acqua era salita.",
}


@pytest.fixture(scope="module")
def lexicon():
    rng = random.Random(3)
    corpus = [prose(rng, 9) for _ in range(200)] + [" ".join(", ".join(f.format(rng.choice(NOUNS)) for f in rng.sample(GERMAN_PARTS, 3)) + "." for _ in range(8)) for _ in range(60)]
    return W.local_lexicon(corpus + list(STUFFED.values()) * 2 + [None, ""])


@pytest.mark.parametrize("name", STUFFED)
def test_stuffed(name, lexicon):
    assert W.stuffing_share(STUFFED[name], lexicon) >= W.SHARE
    assert W.stuffing_share(STUFFED[name] + "\n" + PROSE[:60], lexicon) >= W.SHARE
    assert W.stuffing_share(STUFFED[name] + "\n" + PROSE * 40, lexicon) < W.SHARE


@pytest.mark.parametrize("name", CLEAN)
def test_not_stuffed(name, lexicon):
    assert W.stuffing_share(CLEAN[name], lexicon) < W.SHARE


@pytest.mark.parametrize("name", FOREIGN_PROSE)
def test_prose_of_unknown_languages(name, lexicon):
    assert W.stuffing_share(FOREIGN_PROSE[name], lexicon) == 0.0


@pytest.mark.parametrize("phrase", ["cheap flights to paris ", "hotel deals in rome ", "buy the red shoes "])
def test_phrase_without_separators(phrase, lexicon):
    assert W.stuffing_share(phrase * 20, lexicon) >= W.SHARE
    assert W.stuffing_share(phrase * 20 + "\n" + PROSE * 40, lexicon) < W.SHARE


LONG_PHRASE = "running shoes outlet for men women kids trail road sale prices online store and discount codes coupons with delivery worldwide today "


def test_long_periods(lexicon):
    assert len(LONG_PHRASE.split()) == 21 and W.stuffing_share(LONG_PHRASE * 20, lexicon) >= W.SHARE
    block = [f"the red{i} of shoe{i}" for i in range(60)]
    assert W.stuffing_share("\n".join(block), lexicon) < W.SHARE


@pytest.mark.parametrize("odd", ["size=42", "{sale}", "a = b"])
def test_one_code_mark_is_no_code(odd, lexicon):
    assert W.stuffing_share("red shoes cheap shoes " * 20 + odd + " red shoes cheap shoes" * 20, lexicon) >= W.SHARE
    code = "\n".join(f"total = total + price[{i}]; count = count + 1;" for i in range(40))
    assert W.stuffing_share(code, lexicon) < W.SHARE and W.stuffing_share(" ".join(code.split("\n")), lexicon) < W.SHARE


def test_recurrence():
    words = np.array([1, 2, 3, 1, 2, 3, 9, 8, 1], dtype=np.uint64)
    repeated, regular = W.recurrence(words, np.zeros(9, dtype=np.int64))
    assert repeated.tolist() == [False] * 3 + [True] * 3 + [False, False, True]
    assert regular.tolist() == [False] * 3 + [True] * 3 + [False] * 3
    assert not W.recurrence(words, np.arange(9))[0].any()
    assert W.even_gaps(np.zeros(5, dtype=np.int64), np.zeros(5, dtype=np.int64), np.array([0, 3, 6, 9, 30])).tolist() == [False, True, True, True, False]


def test_function_words_are_learned(lexicon):
    kinds = lambda text: lexicon.of(W.Clauses([text]).exact).tolist()
    assert set(kinds("the and of it in to was und die wir")) == {W.FUNCTION}
    assert W.FUNCTION not in kinds("shoes lattice bakery sale xyzzy")


def test_stuffed_pages_edges(spark):
    rng = random.Random(5)
    rows = [(1, STUFFED["tags"]), (2, None), (3, ""), (4, " \n "), (5, PROSE * 3), (1, STUFFED["tags"]), (6, "#a " * 20000), (7, "x" * 50000)]
    rows += [(100 + i, prose(rng, 9)) for i in range(100)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "id bigint, text string, stuffing double").repartition(3)
    assert sorted(r["id"] for r in W.stuffed_pages(df, "id", "text").collect()) == [1, 1, 6]
    assert W.stuffed_pages(df.limit(0), "id", "text").count() == 0
    assert W.stuffed_pages(df.where("text is null or trim(text) = ''"), "id", "text").count() == 0


QUESTION = "A train leaves Orwick at 9:15 with 40 passengers and stops in three towns on its way. How many passengers reach Larmouth?"
SPANISH = "Un tren sale de Orwick a las nueve con 40 pasajeros y para en tres pueblos. ¿Cuántos pasajeros llegan a la ciudad?"
STEPS = ["The first stop takes 5 passengers away.", "At the second stop 12 people get on the train.", "Because the third town is small, nobody leaves there.", "Adding these gives 47 in total."]


def made(seed, n):
    """Replies of known defect for training and for a held-out test, made from different numbers and steps."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        steps = rng.sample(STEPS, rng.randint(1, 4))
        body = " ".join(steps)
        end = rng.choice(["Answer: {}", "The answer is {}.", "Hence \\boxed{{{}}}", "So the final result is **{}**."]).format(rng.randint(1, 99))
        out += [
            (f"{body} {end}", QUESTION, None),
            (str(rng.randint(1, 99)), QUESTION, None),
            (rng.choice(["", " \n", "Answer:", "\\boxed{}", "<answer></answer>", "…", "​", "```\n```"]), QUESTION, "empty"),
            (body[: -rng.randint(8, 20)] if len(body) > 60 else body[:-9], QUESTION, "truncated"),
            (rng.choice(["I'm sorry, but I can't help with that request.", "My guidelines don't allow me to answer this. I hope you understand.", "I must decline to answer."]), QUESTION, "refusal"),
            (rng.choice(["", "Question: ", "Q: "]) + QUESTION, QUESTION, "copied_question"),
            (f"El primer pueblo pierde {rng.randint(2, 9)} pasajeros y el tren sigue. En el segundo pueblo suben más personas al tren. Respuesta: {rng.randint(1, 99)}", QUESTION, "other_language"),
            (f"{body} {end}", SPANISH, "other_language"),
            (f"{body} {end}", None, None),
        ]
    return out


def test_long_labels_are_empty():
    for r in ("**Final answer:**" + "\n" * 50, "Answer:" + " " * 60, "<response>\n <answer>\n Final answer:\n </answer>\n</response>", "Answer:" + "\u200b" * 60, "<p>" * 30, " " * 90):
        assert P.is_empty(r), r
    for r in ("Answer:" + " " * 60 + "7", "<response>\n <answer>\n Final answer: 12\n </answer>\n</response>", "word " * 20000, "x" + " " * 80, "- " * 60 + "result"):
        assert not P.is_empty(r), r


def mostly_sound(seed, n):
    """A sample as the tagger expects it: nine in ten replies are sound, with names, numbers and options as values."""
    rng = random.Random(seed)
    out = [(r, q) for r, q, _ in made(seed, n // 40)]
    names = [a + b for a in ("Or", "Lar", "Tem", "Vis", "Quel") for b in ("wick", "mouth", "dale", "ford")]
    for _ in range(n):
        steps = rng.sample(STEPS, rng.randint(1, 4)) if rng.random() < 0.8 else rng.sample(SPANISH_STEPS, 2)
        value = rng.choice([str(rng.randint(1, 99)), rng.choice(names), "yes", "no", f"choice_{rng.randint(1, 4)}"])
        end = rng.choice(["Answer: {}", "The answer is {}.", "Hence \\boxed{{{}}}", "So the final result is **{}**."] if steps[0] in STEPS else ["Respuesta: {}", "La respuesta es {}."]).format(value)
        question = QUESTION if steps[0] in STEPS else SPANISH
        out.append((" ".join([*steps, end]) if rng.random() < 0.9 else value, question))
    return out


SPANISH_STEPS = ["El primer pueblo pierde 5 pasajeros y el tren sigue.", "En el segundo pueblo suben más personas al tren.", "Como el tercer pueblo es pequeño, nadie baja allí."]


@pytest.fixture(scope="module")
def tagger():
    return P.train(mostly_sound(1, 900))


def test_pairs_held_out(tagger):
    test = made(2, 40)
    got = tagger.defects([r for r, _, _ in test], [q for _, q, _ in test])
    assert sum(g == w for g, (_, _, w) in zip(got, test)) / len(test) >= 0.97


HELD_OUT = {  # sentences that share no template with the training
    "refusal": ["That topic is off limits for this assistant, sorry.", "I'm declining this request.", "Sorry, I can't do that for you."],
    "other_language": [
        "Ensimmäisellä pysäkillä viisi matkustajaa poistuu junasta. Toisella pysäkillä kaksitoista ihmistä nousee kyytiin. Vastaus: 47",
        "Di halte pertama lima penumpang turun dari kereta. Di halte kedua dua belas orang naik ke dalam kereta. Jawaban: 47",
        "Tại ga đầu tiên năm hành khách xuống tàu. Tại ga thứ hai mười hai người lên tàu. Đáp án: 47",
        "ที่สถานีแรกมีผู้โดยสารลงจากรถไฟห้าคน ที่สถานีที่สองมีคนขึ้นรถไฟสิบสองคน คำตอบคือ 47",
        "Op de eerste halte stappen vijf reizigers uit de trein. Op de tweede halte stappen twaalf mensen in. Antwoord: 47",
    ],
}


@pytest.mark.parametrize("kind", HELD_OUT)
def test_unseen_wordings(tagger, kind):
    got = tagger.defects(HELD_OUT[kind], [QUESTION] * len(HELD_OUT[kind]))
    assert got == [kind] * len(got)


def test_batches_do_not_matter(tagger):
    test = made(5, 6)
    replies, questions = [r for r, _, _ in test] + ["", "a\0b c. d", "12:30 “x” y"], [q for _, q, _ in test] + [None, "", QUESTION]
    together = tagger.defects(replies, questions)
    assert together == [tagger.defects([r], [q])[0] for r, q in zip(replies, questions)]


def test_a_long_reply_among_short_ones(tagger):
    """Thousands of clauses in one reply neither pad the others nor change them."""
    short = [(r, q) for r, q, _ in made(6, 5)]
    long = " ".join(STEPS * 1500) + " Answer: 5"
    together = tagger.defects([long, *(r for r, _ in short)], [QUESTION, *(q for _, q in short)])
    assert together == [None, *tagger.defects([r for r, _ in short], [q for _, q in short])]
    s = Sequences(np.random.default_rng(1).random((3050, 2)), np.array([3000, 20, 0, 25, 5]))
    m = Crf(2, 3)
    m.w[:] = np.random.default_rng(2).normal(size=(2, 3))
    m.t[:] = np.random.default_rng(3).normal(size=(3, 3))
    assert (m.decode(s) == m.decode(s, cells=10)).all()


def test_question_before_a_sound_reply(tagger):
    """A copy of the question in front, words of declining inside the steps: still no defect."""
    rng = random.Random(9)
    texts, want = [], []
    for _ in range(300):
        lead = rng.choice([["The first stop is small."], ["Sorry about the long text."], ["We can help ourselves to a table."]])
        texts.append(" ".join([QUESTION, *lead, *rng.sample(STEPS, 2), f"Answer: {rng.randint(1, 99)}"]))
        want.append(None)
    assert sum(a == b for a, b in zip(tagger.defects(texts, [QUESTION] * 300), want)) >= 285


def test_broken_pairs_edges(spark):
    sample = [(2000 + i, r, q, "z") for i, (r, q) in enumerate(mostly_sound(4, 600))]
    rows = [(i, r, q, "z") for i, (r, q, _) in enumerate(made(3, 20))] + [(900, None, QUESTION, "z"), (901, None, None, "z"), (902, QUESTION, "  ", "z"), (903, "word " * 20000, QUESTION, "z")]
    df = spark.createDataFrame(rows + sample, "id bigint, reply string, question string, defect string").repartition(3)
    got = {r["id"]: r["defect"] for r in P.broken_pairs(df, "id", "reply", "question").collect()}
    assert got[900] == got[901] == "empty" and got.get(902) in (None, "truncated")
    want = {i: d for i, (_, _, d) in enumerate(made(3, 20)) if d}
    assert sum(got.get(i) == d for i, d in want.items()) / len(want) >= 0.97
    assert P.broken_pairs(df.limit(0), "id", "reply", "question").count() == 0


def test_field_learns_a_sequence():
    rng = np.random.default_rng(0)
    seqs, labels = [], []
    for _ in range(200):
        y = np.cumsum(rng.random(8) < 0.2) % 2
        seqs.append(np.stack([np.ones(8), y + rng.normal(0, 0.7, 8)], axis=1))
        labels.append(y)
    m = Crf(2, 2).fit(Sequences(np.concatenate(seqs[:150]), np.full(150, 8)), np.concatenate(labels[:150]), epochs=60, batch=50)
    got = m.decode(Sequences(np.concatenate(seqs[150:]), np.full(50, 8))).reshape(50, 8)
    alone = np.mean([np.mean((x[:, 1] > 0.5) == y) for x, y in zip(seqs[150:], labels[150:])])
    assert np.mean([np.mean(a == b) for a, b in zip(got, labels[150:])]) > alone + 0.05  # neighbours must help
    assert len(m.decode(Sequences(np.zeros((0, 2)), np.zeros(3)))) == 0


def test_queries_have_the_given_columns(spark):
    import __spark_entry__ as e

    cols = {
        "p1_found": ["instance_id", "group_id"], "p2_found": ["id_a", "id_b"], "p3_found": ["record_id", "defect"], "p4_found": ["corpus_table", "corpus_id", "test_id"],
        "p5_found": ["id_a", "id_b"], "p6_ids": ["doc_id", "ids"], "p7_found": ["doc_id"], "p8_found": ["doc_id"],
    }
    folder = "/root/testdata/sf0.001"
    pytest.importorskip("os")
    import os

    if not os.path.isdir(folder):
        pytest.skip("no test data here")
    for name, want in cols.items():
        df = e.queries()[name](spark, folder)
        assert df.columns == want
        assert df.where(" or ".join(f"{c} is null" for c in want)).count() == 0
        assert df.count() == df.distinct().count()


def test_hot_keys_stay_whole(spark):
    """A third of all rows with one key, one text, one length."""
    n = 3000
    rows = [(f"r{i}", ["hot"] if i % 3 == 0 else [f"k{i // 2}"], ("copy of one long question that many records share word for word " * 2) if i % 3 == 0 else f"q{i} " * 3, i % 2 == 0) for i in range(n)]
    df = spark.createDataFrame(rows, "id string, keys array<string>, text string, training boolean").repartition(6)
    from quillmill.llm.neardup import near_groups
    from quillmill.llm.splits import groups

    g = groups(df, "id", "keys", "keys")
    assert g.where("group_id = 'hot'").count() == n // 3 and g.count() == n
    near = near_groups(df, "id", "text", 0.5, bits=12)
    assert near.count() == n // 3 and near.select(F.countDistinct("group_id")).first()[0] == 1
