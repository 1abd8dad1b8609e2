"""A linear-chain conditional random field over clauses with dense features and words of a vocabulary, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class Sequences:
    """Rows of clauses, one after the other: dense features, and the words of each clause by vocabulary place."""

    def __init__(self, x: np.ndarray, lengths: np.ndarray, words: np.ndarray | None = None, owner: np.ndarray | None = None) -> None:
        self.x, self.lengths = x, np.asarray(lengths, dtype=np.int64)
        self.begin = np.cumsum(self.lengths) - self.lengths
        self.words = words if words is not None else np.empty(0, dtype=np.int64)
        self.owner = owner if owner is not None else np.empty(0, dtype=np.int64)  # clause of each word, ascending
        n = np.bincount(self.owner, minlength=len(x))
        self.value = (1.0 / np.sqrt(np.maximum(n, 1)))[self.owner]

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(clauses of the rows as an array rows x longest, mask)."""
        n = self.lengths[rows]
        place = np.arange(int(n.max()) if len(n) else 0)
        mask = place[None, :] < n[:, None]
        return np.where(mask, self.begin[rows][:, None] + place[None, :], 0), mask


def _groups(lengths: np.ndarray, batch: int, cells: int) -> Iterator[tuple[int, int]]:
    """Runs of ascending lengths: at most ``batch`` rows and, padded, ``cells`` places, or a single row."""
    at = 0
    while at < len(lengths):
        stop = min(at + batch, len(lengths))
        while stop - at > 1 and (stop - at) * lengths[stop - 1] > cells:
            stop = at + max(1, min(stop - at - 1, cells // int(lengths[stop - 1])))
        yield at, stop
        at = stop


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis=axis))


class Crf:
    """Weights of features, of words and of transitions for each label."""

    def __init__(self, n_features: int, n_labels: int, n_words: int = 0) -> None:
        self.w = np.zeros((n_features, n_labels))
        self.v = np.zeros((n_words, n_labels))
        self.t = np.zeros((n_labels, n_labels))

    def emissions(self, s: Sequences) -> np.ndarray:
        """Scores (clauses x labels)."""
        e = s.x @ self.w
        if len(s.words):
            for k in range(e.shape[1]):
                e[:, k] += np.bincount(s.owner, self.v[s.words, k] * s.value, minlength=len(e))
        return e

    def _marginals(self, e: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, length, k = e.shape
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for i in range(1, length):
            step = _lse(alpha[:, i - 1, :, None] + self.t[None], 1) + e[:, i]
            alpha[:, i] = np.where(mask[:, i, None], step, alpha[:, i - 1])
        for i in range(length - 2, -1, -1):
            step = _lse(self.t[None] + (e[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
            beta[:, i] = np.where(mask[:, i + 1, None], step, 0.0)
        z = _lse(alpha[:, -1], 1)
        node = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        pair = np.zeros((k, k))
        for i in range(1, length):
            m = mask[:, i]
            if m.any():
                pair += np.exp(alpha[m, i - 1, :, None] + self.t[None] + (e[m, i] + beta[m, i])[:, None, :] - z[m, None, None]).sum(0)
        return node, pair

    def fit(self, s: Sequences, labels: np.ndarray, epochs: int = 4, batch: int = 256, rate: float = 0.05, l2: float = 3e-5) -> Crf:
        """Maximum likelihood by Adam over batches of rows of similar length; deterministic."""
        k = self.t.shape[0]
        gold = np.zeros((len(s.x), k))
        gold[np.arange(len(labels)), labels] = 1
        order = np.argsort(s.lengths, kind="stable")
        order = order[s.lengths[order] > 0]
        groups = []
        for at, stop in _groups(s.lengths[order], batch, 50_000):
            rows = np.sort(order[at:stop])
            place, mask = s.take(rows)
            clauses = place[mask]
            inside = np.zeros(len(s.x), dtype=bool)
            inside[clauses] = True
            new = np.cumsum(inside) - 1
            words = np.flatnonzero(inside[s.owner]) if len(s.owner) else np.empty(0, np.int64)
            part = Sequences(s.x[inside], s.lengths[rows], s.words[words], new[s.owner[words]])
            seen = np.zeros((k, k))
            y = labels[place]
            both = mask[:, 1:] & mask[:, :-1]
            np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
            groups.append((part, np.where(mask, new[place], 0), mask, gold[inside], seen))
        params = (self.w, self.v, self.t)
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        rng, step = np.random.default_rng(7), 0
        for epoch in range(epochs):
            for g in rng.permutation(len(groups)):
                part, place, mask, right, seen = groups[g]
                node, pair = self._marginals(self.emissions(part)[place], mask)
                miss = right.copy()
                miss[place[mask]] -= node[mask]
                n = len(miss)
                gv = np.zeros_like(self.v)
                if len(part.words):
                    for j in range(k):
                        gv[:, j] = np.bincount(part.words, miss[part.owner, j] * part.value, minlength=len(self.v))
                grads = (part.x.T @ miss / n - l2 * self.w, gv / n - l2 * self.v, (seen - pair) / n - l2 * self.t)
                step += 1
                pace = rate * (1 - epoch / epochs)
                for p, g_, (a, b) in zip(params, grads, moments):
                    a += 0.1 * (g_ - a)
                    b += 0.01 * (g_ * g_ - b)
                    p += pace * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
        return self

    def decode(self, s: Sequences, batch: int = 1024, cells: int = 200_000) -> np.ndarray:
        """The most likely label of every clause (Viterbi), rows of similar length together, padded to ``cells`` at most."""
        out = np.zeros(len(s.x), dtype=np.int64)
        if not len(s.x):
            return out
        e = self.emissions(s)
        order = np.argsort(s.lengths, kind="stable")
        order = order[s.lengths[order] > 0]
        for at, stop in _groups(s.lengths[order], batch, cells):
            place, mask = s.take(order[at:stop])
            n, length = mask.shape
            score = e[place[:, 0]]
            back = np.zeros((n, length, self.t.shape[0]), dtype=np.int8)
            for i in range(1, length):
                both = score[:, :, None] + self.t[None]
                back[:, i] = both.argmax(1)
                score = np.where(mask[:, i, None], both.max(1) + e[place[:, i]], score)
            y, rows = score.argmax(1), np.arange(n)
            for i in range(length - 1, -1, -1):
                inside = mask[:, i]
                out[place[inside, i]] = y[inside]
                if i:
                    y = np.where(inside, back[rows, i, y], y)
        return out
