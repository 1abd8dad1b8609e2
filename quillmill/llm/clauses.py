"""Clauses of many texts at once: cut and described with array operations on the texts' code points.

A batch of texts is one array of code points. A clause ends at a line break or after the end mark of a sentence;
its tokens are runs of letters, runs of digits, or single signs of scripts without spaces. Every token has a hash
of its letters (a polynomial, taken from prefix sums) and a hash for the vocabulary, in which all numbers are one.
"""

from __future__ import annotations

import unicodedata

import numpy as np

from quillmill.llm.shingles import mix

SPACE, NEWLINE, LETTER, DIGIT, SIGN, STOP, WIDE_STOP, COLON, COMMA, OPEN, CLOSE, QUOTE, MARKUP, OPERATOR, OTHER = range(15)
N_CLASSES = 15
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
NUMBER = np.uint64(0x1234567)  #: the vocabulary's hash of every number
PAIR = np.uint64(0xD6E8FEB86659FD93)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    kind = np.full(0x110000, OTHER, dtype=np.uint8)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x20000):
        ch = chr(c)
        cat = unicodedata.category(ch)
        if cat[0] in "LM" or ch == "_":
            kind[c] = LETTER
            low = ch.lower()
            lower[c] = ord(low) if len(low) == 1 else c
        elif cat[0] == "N":
            kind[c] = DIGIT
        elif cat[0] in "ZC":
            kind[c] = SPACE
        elif cat == "Ps":
            kind[c] = OPEN
        elif cat == "Pe":
            kind[c] = CLOSE
        elif cat in ("Pi", "Pf"):
            kind[c] = QUOTE
        elif cat == "Sm" or cat == "Pd":
            kind[c] = OPERATOR
    kind[0x20000:0x40000] = SIGN
    for lo, hi in ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF)):  # scripts without spaces
        part = kind[lo : hi + 1]
        part[part == LETTER] = SIGN
    for group, k in (("\n\r  \x00", NEWLINE), (".!?…", STOP), ("。？！", WIDE_STOP), (":：", COLON), (",;、，；", COMMA), ("\"'’`", QUOTE), ("*_#~|\\", MARKUP), ("/^&%$€£+-=<>", OPERATOR)):
        for ch in group:
            if ch != "_":
                kind[ord(ch)] = k
    return kind, lower


_KIND, _LOWER = _tables()
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0][:n], _powers[1][:n]


class Clauses:
    """Tokens and clauses of a list of texts; all attributes are arrays in the order of the texts."""

    def __init__(self, texts: list[str]) -> None:
        norm = [t if t.isascii() else unicodedata.normalize("NFKC", t) for t in texts]
        raw = np.frombuffer(("\0".join(t.replace("\0", " ") for t in norm) + "\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.kind = kind = _KIND[raw]
        self.raw, self.low = raw, _LOWER[raw]
        n = len(raw)
        ends = np.flatnonzero(raw == 0)
        self.n_rows = len(texts)
        self.row_end = ends
        row_begin = np.concatenate(([0], ends[:-1] + 1))
        self.row_begin = row_begin
        prev = np.concatenate(([np.uint8(NEWLINE)], kind[:-1]))
        nxt = np.concatenate((kind[1:], [np.uint8(NEWLINE)]))
        begin = ((kind == LETTER) & (prev != LETTER)) | ((kind == DIGIT) & (prev != DIGIT)) | (kind == SIGN)
        end = ((kind == LETTER) & (nxt != LETTER)) | ((kind == DIGIT) & (nxt != DIGIT)) | (kind == SIGN)
        self.start, self.stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
        p, inverse = _power(n + 1)
        prefix = np.concatenate(([np.uint64(0)], np.cumsum(self.low.astype(np.uint64) * p[:n])))
        self.exact = mix((prefix[self.stop] - prefix[self.start]) * inverse[self.start])
        self.digit = kind[self.start] == DIGIT
        self.word = np.where(self.digit, NUMBER, self.exact)
        # ends of clauses
        place = np.arange(n)
        solid = np.maximum.accumulate(np.where((kind != CLOSE) & (kind != QUOTE) & (kind != MARKUP), place, 0))
        self.ink = np.maximum.accumulate(np.where((kind != SPACE) & (kind != NEWLINE), place, 0))
        self.core = np.maximum.accumulate(np.where((kind != SPACE) & (kind != NEWLINE) & (kind != CLOSE) & (kind != QUOTE) & (kind != MARKUP), place, 0))
        before = np.concatenate(([0], solid[:-1]))
        cut = (kind == NEWLINE) | ((prev == WIDE_STOP) & (kind != WIDE_STOP))
        ended = np.flatnonzero((kind == SPACE) & (kind[before] == STOP))
        b = before[ended]
        edge = lambda at: (at < 0) | (kind[np.maximum(at, 0)] == NEWLINE)
        number = (b > 0) & (kind[np.maximum(b - 1, 0)] == DIGIT) & (raw[b] == 46)
        number &= edge(b - 2) | (kind[np.maximum(b - 2, 0)] == DIGIT) & edge(b - 3)  # the number of a list's item
        cut[ended[~number]] = True
        self.cuts = np.flatnonzero(cut)
        which = np.searchsorted(self.cuts, self.start)
        row = np.searchsorted(ends, self.start)
        fresh = np.ones(len(which), dtype=bool)
        fresh[1:] = which[1:] != which[:-1]
        self.first = np.flatnonzero(fresh)  # the first token of each clause
        self.clause = np.cumsum(fresh) - 1  # of each token
        self.row = row[self.first] if len(row) else row  # of each clause
        self.token_row = row
        self.n = len(self.first)
        self.size = np.diff(np.concatenate((self.first, [len(self.start)])))
        final = self.first + self.size - 1
        self.end = self.cuts[np.searchsorted(self.cuts, self.stop[final] - 1 if False else self.stop[final], "left")] if self.n else np.empty(0, np.int64)
        self.begin = self.start[self.first]
        # the text between two clauses belongs to the earlier one, down to the end of the row
        self.is_last = np.ones(self.n, dtype=bool)
        self.is_last[:-1] = self.row[1:] != self.row[:-1]
        self.is_first = np.ones(self.n, dtype=bool)
        self.is_first[1:] = self.row[1:] != self.row[:-1]
        self.close = np.where(self.is_last, ends[self.row], self.end) if self.n else self.end
        self.per_row = np.bincount(self.row, minlength=self.n_rows)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash of two exact tokens in a row, hash of their vocabulary forms, place of the first), inside clauses."""
        at = np.flatnonzero(self.clause[1:] == self.clause[:-1]) if len(self.start) > 1 else np.empty(0, np.int64)
        two = lambda x: mix(x[at] * PAIR + x[at + 1])
        return two(self.exact), two(self.word), at

    def mean(self, values: np.ndarray) -> np.ndarray:
        """Mean over the tokens of each clause."""
        return np.add.reduceat(values.astype(np.float64), self.first) / self.size if self.n else np.empty(0)
