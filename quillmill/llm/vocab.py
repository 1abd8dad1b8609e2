"""Public byte-level BPE vocabularies: loading, exact merging, token ranks."""

from __future__ import annotations

import base64
import heapq
import os

DEFAULT_VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def load_ranks(path: str | os.PathLike = DEFAULT_VOCAB) -> dict[bytes, int]:
    """Token bytes to id of a rank file (one base64 token and its rank a line); the rank is the id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_exact(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair merging of one word: always the adjacent pair of lowest rank, leftmost first.

    A linked list with a heap of candidate pairs, so a word of n bytes takes O(n log n), however long.
    """
    n = len(word)
    if n < 2:
        return [ranks[word]] if n else []
    end = list(range(1, n + 1))  # part i covers word[i:end[i]]; end[i] is also the next part
    prev = list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []
    for i in range(n - 1):
        r = ranks.get(word[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    alive = bytearray(b"\x01") * n
    while heap:
        r, i, stop = heapq.heappop(heap)
        j = end[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue  # one of the two parts has changed since
        alive[j] = 0
        end[i] = stop
        if stop < n:
            prev[stop] = i
            s = ranks.get(word[i : end[stop]])
            if s is not None:
                heapq.heappush(heap, (s, i, end[stop]))
        p = prev[i]
        if p >= 0:
            s = ranks.get(word[p:stop])
            if s is not None:
                heapq.heappush(heap, (s, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out
