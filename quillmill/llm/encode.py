"""Encoding of a whole corpus with a public byte-level BPE vocabulary: speculate and verify.

Greedy longest match *proposes* the tokens of a word; by a known property of byte-pair merging a
proposal is the exact encoding if and only if every adjacent pair of its tokens is compatible, that is,
merging the bytes of the two alone gives the two back. The pairs of all new words of a batch are checked
together against a table of verdicts, and only words with an incompatible pair undergo exact merging.
Words are encoded once per worker and kept in a bounded table; texts are then numpy gathers from it.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quillmill.llm.vocab import DEFAULT_VOCAB, load_ranks, merge_exact

# Unicode White_Space, and the word pattern of the byte-level vocabularies.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_WORDS = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}++| ?\p{{N}}++| ?[^{_SPACE}\p{{L}}\p{{N}}]++|[{_SPACE}]++$|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]"

#: Words never cross these units, so a text may be cut into units before it is cut into words.
_UNIT = re.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]")
_WORD = regex.compile(_WORDS)

CHUNK_CHARS = 4_000_000  #: texts handled at once in a worker
TABLE_UNITS = 400_000  #: units kept in a worker's table before it is started anew
LONG_UNIT = 200  #: longer units are encoded, but not kept


class Encoder:
    """Encodes texts; holds the table of known units and of pair verdicts of one worker."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=1)
        self.tokens = {i: b for b, i in ranks.items()}
        self.verdicts: dict[int, bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.merged = 0  # words that needed exact merging
        self._reset()

    def _reset(self) -> None:
        self.units: dict[str, int] = {}
        self.start: list[int] = []
        self.size: list[int] = []
        self.flat: list[int] = []

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match from the left."""
        get, out, i, n = self.ranks.get, [], 0, len(word)
        while i < n:
            j = min(n, i + self.longest)
            while (t := get(word[i:j])) is None:
                j -= 1
            out.append(t)
            i = j
        return out

    def verify(self, proposals: list[list[int]]) -> np.ndarray:
        """For each proposal, whether every adjacent pair of its tokens is compatible."""
        size = np.fromiter(map(len, proposals), dtype=np.int64, count=len(proposals))
        flat = np.fromiter((t for p in proposals for t in p), dtype=np.int64, count=int(size.sum()))
        if len(flat) < 2:
            return np.ones(len(proposals), dtype=bool)
        owner = np.repeat(np.arange(len(proposals)), size)
        inside = owner[:-1] == owner[1:]
        codes, back = np.unique((flat[:-1] << 20 | flat[1:])[inside], return_inverse=True)
        good = np.empty(len(codes), dtype=bool)
        for k, c in enumerate(codes.tolist()):
            v = self.verdicts.get(c)
            if v is None:
                a, b = c >> 20, c & 0xFFFFF
                v = self.verdicts[c] = merge_exact(self.tokens[a] + self.tokens[b], self.ranks) == [a, b]
            good[k] = v
        ok = np.ones(len(proposals), dtype=bool)
        ok[owner[:-1][inside][~good[back]]] = False
        return ok

    def encode_words(self, words: Iterable[str]) -> None:
        """Add words to the table of words: propose all, check all pairs, merge what fails."""
        words = [w for w in words if w not in self.words]
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        proposals = [[t] if (t := self.ranks.get(b)) is not None else self.propose(b) for b in raw]
        for w, b, p, ok in zip(words, raw, proposals, self.verify(proposals).tolist()):
            if not ok:
                self.merged += 1
                p = merge_exact(b, self.ranks)
            self.words[w] = tuple(p)

    def _learn(self, units: set[str]) -> None:
        cut = {u: _WORD.findall(u) for u in units}
        self.encode_words({w for ws in cut.values() for w in ws})
        known = self.words
        for u, ws in cut.items():
            ids = [t for w in ws for t in known[w]]
            self.units[u] = len(self.start)
            self.start.append(len(self.flat))
            self.size.append(len(ids))
            self.flat += ids
        if len(self.words) > TABLE_UNITS or len(self.verdicts) > 4 * TABLE_UNITS:
            self.words.clear()
            self.verdicts.clear()

    def _gather(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tables and, for the units of all texts in order, their places; units per text."""
        if len(self.units) > TABLE_UNITS:
            self._reset()
        per = [_UNIT.findall(t) for t in texts]
        flat = [u for us in per for u in us]
        new = set(flat).difference(self.units)
        if new:
            self._learn(new)
        at = np.fromiter(map(self.units.__getitem__, flat), dtype=np.int64, count=len(flat))
        for u in [u for u in new if len(u) > LONG_UNIT]:
            del self.units[u]
        return at, np.array(self.size, dtype=np.int64), np.fromiter(map(len, per), dtype=np.int64, count=len(per))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and the number of ids of each text."""
        at, size, per = self._gather(texts)
        n = size[at]
        begin = np.cumsum(n) - n
        source = np.repeat(np.array(self.start, dtype=np.int64)[at] - begin, n) + np.arange(int(n.sum()))
        ids = np.array(self.flat, dtype=np.int32)[source] if len(source) else np.empty(0, dtype=np.int32)
        return ids, self._per_text(n, per)

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of ids of each text."""
        at, size, per = self._gather(texts)
        return self._per_text(size[at], per)

    @staticmethod
    def _per_text(n: np.ndarray, per: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(n)))
        stop = np.cumsum(per)
        return total[stop] - total[stop - per]


def chunks(texts: list[str | None], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of a bounded number of characters (or a single longer one), nulls as empty."""
    first, held, chars = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t or "")
        chars += len(held[-1])
        if chars >= limit:
            yield first, held
            first, held, chars = i + 1, [], 0
    if held:
        yield first, held


_workers: dict[int, Encoder] = {}


def worker_encoder(shared) -> Encoder:
    """The encoder of this Python worker for a broadcast vocabulary; it outlives a task."""
    ranks = shared.value
    e = _workers.get(id(ranks))
    if e is None or e.ranks is not ranks:
        _workers.clear()
        e = _workers[id(ranks)] = Encoder(ranks)
    return e


def encode(df: DataFrame, id_col: str, text_col: str, vocab: str = DEFAULT_VOCAB, ids_col: str = "ids") -> DataFrame:
    """(id, ids array<int>): the ids of each row's whole text, without special tokens.

    Special-token strings inside a text are ordinary text. A null or empty text has an empty list; rows are
    kept one for one, repeated rows included; other columns are ignored, whatever their names. One narrow
    pass without a shuffle: the vocabulary (fixed by its file, about 50,000 entries) is broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(load_ranks(os.fspath(vocab)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_encoder(shared)
        for b in batches:
            keys = b.column(0)
            for first, texts in chunks(b.column(1).to_pylist()):
                ids, n = enc.encode(texts)
                offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                yield pa.RecordBatch.from_arrays([keys.slice(first, len(texts)), lists], names=["k", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(df[id_col].alias("k"), df[text_col].alias("t")).mapInArrow(run, f"k {kind}, ids array<int>")
    return out.toDF(id_col, ids_col)


def count_tokens(df: DataFrame, id_col: str, text_col: str, vocab: str = DEFAULT_VOCAB, size_col: str = "tokens") -> DataFrame:
    """(id, tokens bigint): the number of ids :func:`encode` gives each row; 0 for null and empty texts."""
    shared = df.sparkSession.sparkContext.broadcast(load_ranks(os.fspath(vocab)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_encoder(shared)
        for b in batches:
            n = [enc.count(texts) for _, texts in chunks(b.column(1).to_pylist())]
            sizes = np.concatenate(n) if n else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], names=["k", "n"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(df[id_col].alias("k"), df[text_col].alias("t")).mapInArrow(run, f"k {kind}, n bigint")
    return out.toDF(id_col, size_col)
