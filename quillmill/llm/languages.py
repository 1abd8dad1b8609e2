"""Languages told by letter triples: models learned from a sample, from the frequent words of each language on.

The frequent words label those sample texts in which they leave no doubt; the triples of letters of these texts
give each language's model, and that model tells every clause, also those without a frequent word. What no model
explains as well as the sample's own texts (a floor taken from the sample) is in none of the languages.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

from quillmill.llm.clauses import LETTER, SIGN, Clauses

BITS = 16
_LETTERS = re.compile(r"[^\W\d_]+")
MOST_LANGUAGES = 24
SEEDS = 3  #: frequent words that a sample text must show to be labelled


def triples(c: Clauses) -> tuple[np.ndarray, np.ndarray]:
    """(place, bucket) of the letter triples that begin inside words; word edges count as a letter."""
    inside = (c.kind == LETTER) | (c.kind == SIGN)
    x = np.where(inside, c.low, 32).astype(np.uint64)
    # none reaches from one text into the next
    at = np.flatnonzero((inside[:-2] | inside[1:-1]) & (c.raw[:-2] != 0) & (c.raw[1:-1] != 0)) if len(x) > 2 else np.empty(0, np.int64)
    h = (x[at] * np.uint64(0x9E3779B97F4A7C15) + x[at + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + x[at + 2] * np.uint64(0x165667B19E3779F9))
    h ^= h >> np.uint64(29)
    return at, ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int64)


def quoted(c: Clauses) -> np.ndarray:
    """Which places lie inside a quotation of a longer text (typographic or straight double quotes)."""
    opens = (c.raw == 0x201C) | (c.raw == 0xAB) | (c.raw == 0x201E)
    shuts = (c.raw == 0x201D) | (c.raw == 0xBB)
    straight = c.raw == 34
    row = np.repeat(np.arange(c.n_rows), c.row_end - c.row_begin + 1)
    count = lambda x: (lambda s: s - np.concatenate(([0], s[c.row_end[:-1]]))[row])(np.cumsum(x))
    inside = count(opens.astype(np.int64) - shuts) > 0
    if straight.any():
        inside |= count(straight.astype(np.int64)) % 2 == 1
    # a reply that is a quotation as a whole is no quotation inside a reply
    whole = np.isin(c.raw[np.minimum(_first_ink(c), len(c.raw) - 1)], (34, 0x201C, 0xAB, 0x201E))
    return inside & ~whole[row]


def _first_ink(c: Clauses) -> np.ndarray:
    ink = np.flatnonzero((c.kind != 0) & (c.kind != 1))
    return ink[np.minimum(np.searchsorted(ink, c.row_begin), len(ink) - 1)] if len(ink) else c.row_begin


class Languages:
    """Letter-triple models of the languages that a sample shows enough of."""

    def __init__(self, seeds: dict[str, str]) -> None:
        self.seeds = {k: frozenset(v.split()) for k, v in seeds.items()}
        self.names: list[str] = []
        self.logp = np.zeros((1 << BITS, 1), dtype=np.float32)
        self.floor = 0.0

    def label(self, text: str) -> str | None:
        """The language that a text's frequent words leave no doubt of."""
        hits: Counter = Counter()
        for w in _LETTERS.findall(text.lower()):
            for k, known in self.seeds.items():
                if w in known:
                    hits[k] += 1
        best = hits.most_common(2)
        return best[0][0] if best and best[0][1] >= SEEDS and (len(best) == 1 or best[0][1] >= 1.5 * best[1][1]) else None

    def fit(self, texts: list[str]) -> Languages:
        """Models from the texts that the frequent words label, then once more from all that these models tell."""
        texts = [t for t in texts if t and t.strip()]
        labels = [self.label(t) for t in texts]
        names = sorted({k for k in labels if k})[:MOST_LANGUAGES]
        if not names:
            return self
        self.names = names
        c = Clauses(texts)
        at, bucket = triples(c)
        keep = ~quoted(c)[at]
        at, bucket = at[keep], bucket[keep]
        row = np.searchsorted(c.row_end, at)
        y = np.array([names.index(k) if k else -1 for k in labels])
        for _ in range(2):
            self._count(bucket, y[row])
            total = np.stack([np.bincount(row, self.logp[bucket, k], minlength=len(texts)) for k in range(len(names))], axis=1)
            n = np.bincount(row, minlength=len(texts))
            mean = total.max(1) / np.maximum(n, 1)
            told = n >= 20
            if not told.any():
                break
            self.floor = float(np.quantile(mean[told], 0.02)) - 0.5
            y = np.where(told & (mean > self.floor), total.argmax(1), -1)
        return self

    def _count(self, bucket: np.ndarray, label: np.ndarray) -> None:
        k = len(self.names)
        counts = np.stack([np.bincount(bucket[label == j], minlength=1 << BITS) for j in range(k)], axis=1).astype(np.float64)
        counts = np.sqrt(counts)  # sentences that a sample repeats must not make all others unlikely
        size = counts.sum(0) + 1.0
        # rare triples of a small sample are taken for half as likely as one seen once
        self.logp = np.log((counts + 0.5) / (size + 0.5 * 4096)).astype(np.float32)

    def spoken(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language of each text by its scores, -1 if none; the mean that text of its language should reach)."""
        k = len(self.names)
        n = np.maximum(rows[:, k], 1)
        if not k:
            return np.full(len(rows), -1), np.zeros(len(rows))
        best = rows[:, :k].argmax(1)
        top = rows[np.arange(len(rows)), best] / n
        second = np.sort(rows[:, :k], axis=1)[:, -2] / n if k > 1 else np.full(len(rows), -np.inf)
        # a small sample doesn't know all of a language: a clear lead over the others then tells it
        good = (rows[:, k] > 0) & ((top > self.floor) | (top > self.floor - 2) & (top - second > 0.3))
        return np.where(good, best, -1), np.minimum(self.floor, top)

    def scores(self, c: Clauses) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(per clause and language: log-likelihood, last column the number of triples; that number; the first per row)."""
        k = len(self.names)
        out, rows = np.zeros((c.n, k + 1)), np.zeros((c.n_rows, k + 1))
        if not k or not c.n:
            return out, np.zeros(c.n), rows
        at, bucket = triples(c)
        keep = ~quoted(c)[at]
        at, bucket = at[keep], bucket[keep]
        # of the clause whose first token begins last before the triple
        clause = np.searchsorted(c.begin, at + 1, "right") - 1
        good = (clause >= 0)
        at, bucket, clause = at[good], bucket[good], clause[good]
        n = np.bincount(clause, minlength=c.n)
        for j in range(k):
            out[:, j] = np.bincount(clause, self.logp[bucket, j], minlength=c.n)
        out[:, k] = n
        for j in range(k + 1):
            rows[:, j] = np.bincount(c.row, out[:, j], minlength=c.n_rows)
        return out, n, rows
