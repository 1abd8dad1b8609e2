"""Keyword-stuffed and link-list pages: regular recurrence of terms and signs, and lists without function words.

A page is a sequence of terms and of signs (links, markup tags, hash and currency marks, separators, line ends). For
every term the gap to its last occurrence is taken; a term is *regular* where its neighbour comes back at the same
lag (the sequence agrees with itself at that lag) or where its own gaps are even. Signs are regular where their gaps
hardly change. Sentences repeat terms, too, but at uneven gaps, and the terms that come back most are function words.

Which words are function words is learned from the corpus, whatever its languages: words that stand in many
documents and, where they stand, in a good part of the sentences, sentences being units that end like one and aren't
regular. A page whose words the corpus doesn't know is judged by its regularity alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.clauses import COLON, DIGIT, LETTER, NEWLINE, SPACE, STOP, WIDE_STOP, Clauses
from quillmill.llm.encode import chunks

SHARE = 2 / 3  #: share of the page's text that makes it a stuffed one
DOCUMENT_SHARE = 0.0005  #: share of the documents that a word of the lexicon stands in
SENTENCE_SHARE = 0.03  #: share of its documents' other sentences that a function word stands in; 0.01 for words of a quarter of all documents
MONOTONE = 0.45  #: most function words that regular repetition may have; sentences said again have more
FUNCTION, CONTENT = 1, 2

_SEPARATORS = np.zeros(0x110000, dtype=bool)
_SEPARATORS[[ord(c) for c in "|•·;,>»/~*、，；"]] = True
_CODE = np.zeros(0x110000, dtype=bool)
_CODE[[ord(c) for c in "{}=;:()[]<>\"'`+*"]] = True
_ASSIGN = np.zeros(0x110000, dtype=bool)
_ASSIGN[[ord(c) for c in "{}="]] = True
_MONEY = np.zeros(0x110000, dtype=bool)
_MONEY[[ord(c) for c in "$€£"]] = True
_BREAK = np.zeros(0x110000, dtype=bool)
_BREAK[[ord(c) for c in "<>\"'()[]{},;|“”"]] = True


class Lexicon:
    """Function words and known content words, as sorted hashes with their kind."""

    def __init__(self, words: np.ndarray, kinds: np.ndarray) -> None:
        order = np.argsort(words)
        self.words, self.kinds = words[order], kinds[order]

    def of(self, h: np.ndarray) -> np.ndarray:
        """FUNCTION, CONTENT or 0 for each hash."""
        if not len(self.words):
            return np.zeros(len(h), dtype=np.int8)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, self.kinds[at], 0).astype(np.int8)


def _spans(c: Clauses) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places inside links, places inside tags, first places of links and tags)."""
    raw, kind = c.raw, c.kind
    n = len(raw)
    tag = np.zeros(n + 1, dtype=np.int32)
    nxt = np.concatenate((kind[1:], [np.uint8(NEWLINE)]))
    after = np.concatenate((raw[1:], [0]))
    opens = np.flatnonzero((raw == 60) & ((nxt == LETTER) | (after == 47)))
    shuts, less = np.flatnonzero(raw == 62), np.flatnonzero((raw == 60) | (kind == NEWLINE))
    begins = np.zeros(n, dtype=bool)
    if len(opens) and len(shuts):
        at = np.searchsorted(shuts, opens)
        end = np.where(at < len(shuts), shuts[np.minimum(at, len(shuts) - 1)], n)
        stop = np.searchsorted(less, opens, "right")
        good = (end < n) & (end < np.where(stop < len(less), less[np.minimum(stop, len(less) - 1)], n))
        np.add.at(tag, opens[good], 1)
        np.add.at(tag, end[good] + 1, -1)
        begins[opens[good]] = True
    tags = np.cumsum(tag[:n]) > 0
    # a link: a piece without spaces, brackets or quotes that holds :// or a name with a dot before letters
    edge = (kind == SPACE) | (kind == NEWLINE) | _BREAK[raw]
    piece = np.cumsum(edge)
    before = np.concatenate(([np.uint8(NEWLINE)], kind[:-1]))
    two = np.concatenate((kind[2:], [np.uint8(NEWLINE)] * 2))[:n]
    dot = (raw == 46) & ((before == LETTER) | (before == DIGIT)) & (nxt == LETTER) & (two == LETTER) & (after == c.low[np.minimum(np.arange(n) + 1, n - 1)])
    dot |= (raw == 58) & (after == 47) & (np.concatenate((raw[2:], [0, 0]))[:n] == 47)
    links = np.isin(piece, piece[dot]) & ~edge if dot.any() else np.zeros(n, dtype=bool)
    first = links & ~np.concatenate(([False], links[:-1]))
    begins |= first
    return links, tags, begins


class Pages:
    """Units (lines and sentences) of a batch of pages, with the regularity of their terms and signs."""

    def __init__(self, texts: list[str]) -> None:
        self.c = c = Clauses(texts)
        raw, kind = c.raw, c.kind
        n = len(raw)
        links, tags, begins = _spans(c)
        ink = (kind != SPACE) & (kind != NEWLINE)
        self.ink = np.concatenate(([0], np.cumsum(ink)))
        self.total = self.ink[c.row_end] - self.ink[c.row_begin]
        count = lambda mask: np.concatenate(([0], np.cumsum(mask)))
        free = ~(links | tags)
        # spans of the units: from the cut before to the cut after
        cut_at = np.searchsorted(c.cuts, c.begin, "left") - 1
        self.begin = np.where(cut_at >= 0, c.cuts[np.maximum(cut_at, 0)], 0) if c.n else c.begin
        self.begin = np.maximum(self.begin, c.row_begin[c.row]) if c.n else self.begin
        self.close = c.end
        part = lambda mask: (lambda s: s[self.close] - s[self.begin])(count(mask))
        self.size = part(ink)
        nxt = np.concatenate((kind[1:], [np.uint8(NEWLINE)]))
        hashes = (raw == 35) & (nxt == LETTER) & free
        money = _MONEY[raw] & free
        separators = _SEPARATORS[raw] & free
        self.links, self.link_ink, self.tag_ink = part(begins & links), part(links & ink), part(tags & ink)
        self.hashes, self.money, self.separators = part(hashes), part(money), part(separators)
        self.code_marks, self.assigns = part(_CODE[raw] & free), part(_ASSIGN[raw] & free)
        fence = np.cumsum((raw == 96).astype(np.int64))
        base = np.concatenate(([0], fence[c.row_end[:-1]]))
        self.fenced = ((fence[self.begin] - base[c.row]) // 3) % 2 == 1 if c.n else np.empty(0, bool)
        core = c.core[np.maximum(self.close - 1, 0)]
        last = kind[core]
        self.closed = ((last == STOP) | (last == WIDE_STOP) | (last == COLON)) & (core >= self.begin) if c.n else np.empty(0, bool)
        # terms, and the gaps at which they come back
        keep = free[c.start]
        self.unit, self.word, self.digit, self.row = c.clause[keep], c.exact[keep], c.digit[keep], c.token_row[keep]
        self.letters = ~self.digit
        at = c.start[keep]
        self.tagged = raw[np.maximum(at - 1, 0)] == 35  # a hash mark makes any word a tag
        self.repeated, self.regular = recurrence(self.word, self.row)
        # signs, and whether their gaps are even
        marks = np.flatnonzero(begins | hashes | money | separators | (kind == NEWLINE))
        what = np.where(links[marks], 1, np.where(tags[marks], 2, raw[marks].astype(np.int64) + 3))
        what = np.where(kind[marks] == NEWLINE, 0, what)
        row = np.searchsorted(c.row_end, marks)
        place = np.searchsorted(c.start[keep], marks) + np.arange(len(marks))
        even = even_gaps(what, row, place)
        owner = np.searchsorted(c.begin, marks, "right") - 1
        owner = np.where((owner >= 0) & (c.row[np.maximum(owner, 0)] == row), owner, owner + 1) if c.n else owner
        good = (owner >= 0) & (owner < c.n)
        self.signs = np.bincount(owner[good], minlength=c.n)
        self.even_signs = np.bincount(owner[good], even[good], minlength=c.n)

    def per_unit(self, values: np.ndarray) -> np.ndarray:
        """Sum over the terms of each unit."""
        return np.bincount(self.unit, values, minlength=self.c.n)


def recurrence(word: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(terms that came before in their page, terms that come back regularly).

    Regular: the term before or after comes back at the same lag, or the term's last two gaps are even.
    """
    n = len(word)
    before = np.full(n, -1)
    order = np.lexsort((np.arange(n), word, row))
    same = (word[order][1:] == word[order][:-1]) & (row[order][1:] == row[order][:-1])
    before[order[1:][same]] = order[:-1][same]
    gap = np.where(before >= 0, np.arange(n) - before, 0)
    repeated = gap > 0
    with_next = np.zeros(n, dtype=bool)
    with_next[:-1] = repeated[:-1] & (gap[1:] == gap[:-1]) & (row[1:] == row[:-1])
    regular = with_next.copy()
    regular[1:] |= with_next[:-1]
    last = np.where(before >= 0, gap[np.maximum(before, 0)], 0)
    return repeated, regular | repeated & (last > 0) & (4 * np.abs(gap - last) <= np.maximum(gap, last)) & (gap <= 64)


def even_gaps(what: np.ndarray, row: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Signs whose gap to the last sign of their kind is like the one before or after it."""
    n = len(what)
    order = np.lexsort((place, what, row))
    w, r, p = what[order], row[order], place[order]
    gap = np.zeros(n, dtype=np.int64)
    same = (w[1:] == w[:-1]) & (r[1:] == r[:-1])
    gap[1:][same] = (p[1:] - p[:-1])[same]
    alike = np.zeros(n, dtype=bool)
    alike[1:] = (gap[1:] > 0) & (gap[:-1] > 0) & (np.abs(gap[1:] - gap[:-1]) <= 1 + np.minimum(gap[1:], gap[:-1]) // 3) & same
    alike[:-1] |= alike[1:]
    out = np.zeros(n, dtype=bool)
    out[order] = alike
    return out


def word_counts(p: Pages) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, documents, of those that have it in a sentence: other sentences with it, other sentences), summed over pages."""
    c = p.c
    terms, regular = p.per_unit(np.ones(len(p.unit))), p.per_unit(p.regular)
    sentence = p.closed & (terms >= 4) & (regular <= 0.3 * terms) & (p.links == 0) & (p.tag_ink == 0) & ~p.fenced
    n_sentences = np.bincount(c.row, sentence, minlength=c.n_rows).astype(np.int64)
    use = p.letters
    words, at = np.unique(p.word[use], return_inverse=True)
    k = max(len(words), 1)
    row_word = np.unique(p.row[use] * k + at)
    documents = np.bincount(row_word % k, minlength=len(words))
    inside = sentence[p.unit[use]]
    unit_word = np.unique(p.unit[use][inside] * k + at[inside])
    # one sentence of a document is why it counts; how many of its others have the word?
    told, n_with = np.unique(c.row[unit_word // k] * k + unit_word % k, return_counts=True)
    others = np.bincount(told % k, n_with - 1, minlength=len(words))
    all_others = np.bincount(told % k, n_sentences[told // k] - 1, minlength=len(words))
    return words, documents, others.astype(np.int64), all_others.astype(np.int64)


def lexicon_of(words: np.ndarray, documents: np.ndarray, with_word: np.ndarray, sentences: np.ndarray, n: int) -> Lexicon:
    """The lexicon from the counts over ``n`` documents."""
    known = documents >= max(2, DOCUMENT_SHARE * n)
    # twenty sentences more, so that a few sentences make no function word
    least = np.where(4 * documents >= n, 0.01, SENTENCE_SHARE)
    function = with_word >= least * (sentences + 20)
    return Lexicon(words[known], np.where(function, FUNCTION, CONTENT)[known].astype(np.int8))


CHUNK = 300_000  #: characters of pages handled at once, so that the arrays stay near the processor


def stuffing(p: Pages, lexicon: Lexicon) -> np.ndarray:
    """Share of each page's characters (white space apart) that are stuffing; 0 for pages without text."""
    c = p.c
    if not c.n:
        return np.zeros(c.n_rows)
    kind = np.where(p.tagged, CONTENT, lexicon.of(p.word))
    terms = p.per_unit(np.ones(len(p.unit)))
    letters = p.per_unit(p.letters)
    function, known = p.per_unit((kind == FUNCTION) & p.letters), p.per_unit((kind > 0) & p.letters)
    regular, repeated = p.per_unit(p.regular), p.per_unit(p.repeated)
    some = np.maximum(letters, 1)
    structured = (p.links > 0) | (p.tag_ink > 0.3 * p.size) | (p.hashes >= np.maximum(2, 0.4 * terms)) | (p.money > 0) & (p.separators > 1)
    code = p.fenced | (p.assigns > 0) & (5 * p.code_marks >= terms) & (p.links == 0) & (p.tag_ink == 0)
    figures = (letters < 0.7 * terms) & ~structured
    # a sentence: function words enough, and not the same over and over
    f = function / some
    monotone = (regular >= 0.6 * terms) & (f <= MONOTONE)
    prose = (f >= np.where(p.closed, 0.15, 0.3)) & ~monotone & (letters >= 3) | (f >= 0.5)
    breaks = code | prose & (terms > 0) | figures
    # runs of units between sentences, code and figures
    fresh = np.ones(c.n, dtype=bool)
    fresh[1:] = breaks[1:] | breaks[:-1] | (c.row[1:] != c.row[:-1])
    run = np.cumsum(fresh) - 1
    total = lambda x: np.bincount(run, x)
    n, a, fn, kn = total(terms), total(letters), total(function), total(known)
    reg, rep, units = total(regular), total(repeated), total(np.ones(c.n))
    signs, even = total(p.signs), total(p.even_signs)
    struct = total(structured * p.size) / np.maximum(total(p.size), 1)
    a1, n1 = np.maximum(a, 1), np.maximum(n, 1)
    recurrent = (reg >= 0.3 * n1) & (fn <= MONOTONE * a1) & (n >= 6) & (rep >= 0.3 * n1)
    # signs at even gaps between few terms each, hardly a function word, words that the corpus knows
    density = signs / n1
    told = (kn >= 0.5 * a1) | (struct >= 0.5)
    listed = (density >= 0.2) & (even >= 0.35 * np.maximum(signs, 1)) & (fn <= 0.12 * a1) & told & (signs >= 4)
    nouns = (n >= 12) & (fn <= 0.04 * a1) & (kn >= 0.7 * a1) & (total(p.closed * terms) <= 0.2 * n1)
    bad = (recurrent | listed | nouns) & ~total(breaks).astype(bool)
    found = np.bincount(c.row, p.size * bad[run], minlength=c.n_rows)
    return found / np.maximum(p.total, 1)


def stuffing_share(text: str | None, lexicon: Lexicon) -> float:
    """The share for one text; 0 for null, empty and blank texts."""
    return float(stuffing(Pages([text or ""]), lexicon)[0])


def _add(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Counts of several batches, one row a word."""
    words, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return words, *(np.bincount(at, np.concatenate([p[k] for p in parts]), minlength=len(words)).astype(np.int64) for k in (1, 2, 3))


def local_lexicon(texts: list[str | None]) -> Lexicon:
    """The lexicon of a list of texts."""
    parts = [word_counts(Pages(part)) for _, part in chunks(texts, CHUNK)]
    return lexicon_of(*_add(parts), len(texts)) if parts else Lexicon(np.empty(0, np.uint64), np.empty(0, np.int8))


HELD_WORDS = 500_000  #: words that a task counts before it passes them on (about 16 MB)


def corpus_lexicon(df: DataFrame, text_col: str) -> Lexicon:
    """The lexicon of all texts of a corpus: counts added up in every task, then by word.

    Only words of at least ``DOCUMENT_SHARE`` of the documents reach the driver: as a document of w different words
    adds w to the sum of all counts, there are at most w / DOCUMENT_SHARE of them for documents of w words on average.
    """
    texts = df.select(F.col(text_col).alias("t")).where("t is not null")
    n = texts.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def rows() -> pa.RecordBatch:
            w, *counts = _add(held)
            return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), *map(pa.array, counts)], names=["w", "d", "a", "s"])

        for b in batches:
            for _, part in chunks(b.column(0).to_pylist(), CHUNK):
                held.append(word_counts(Pages(part)))
                size += len(held[-1][0])
                if size >= 2 * HELD_WORDS:
                    held = [_add(held)]
                    size = len(held[0][0])
                    if size >= HELD_WORDS:
                        yield rows()
                        held, size = [], 0
        if held:
            yield rows()

    total = texts.mapInArrow(run, "w bigint, d bigint, a bigint, s bigint").groupBy("w").agg(F.sum("d").alias("d"), F.sum("a").alias("a"), F.sum("s").alias("s"))
    got = total.where(F.col("d") >= F.lit(max(2, DOCUMENT_SHARE * n))).toArrow()
    return lexicon_of(got.column("w").to_numpy().view(np.uint64), *(got.column(k).to_numpy() for k in ("d", "a", "s")), n)


def stuffed_pages(df: DataFrame, id_col: str, text_col: str, share: float = SHARE) -> DataFrame:
    """(id, stuffing) of the pages whose stuffing makes up at least ``share`` of the whole text.

    Null, empty and blank texts are never flagged; every row counts for itself; other columns are ignored. One pass
    counts the words of the corpus (only counts are shuffled), one narrow pass judges the pages.
    """
    shared = df.sparkSession.sparkContext.broadcast(corpus_lexicon(df, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [stuffing(Pages(part), shared.value) for _, part in chunks(b.column(1).to_pylist(), CHUNK)]
            s = np.concatenate(parts) if parts else np.empty(0)
            good = pa.array(s >= share - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(good), pa.array(s).filter(good)], names=["k", "s"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("k"), df[text_col].alias("t")).mapInArrow(run, f"k {kind}, s double").toDF(id_col, "stuffing")
