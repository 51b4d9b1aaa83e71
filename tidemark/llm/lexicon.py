"""Minimal acyclic word transducer and exact byte-pair merging for one public vocabulary.

The transducer is a shared-suffix automaton over the UTF-8 bytes of frequent words. Every edge
carries the number of words that sort before it among its siblings, so the sum along a path is
the word's rank, and the rank points at the word's ids. It is stored as one int64 array, which
executors map into memory; whole batches of words walk it in lockstep with NumPy.
"""

from __future__ import annotations

import base64
import heapq
import io
import re
import sys
import unicodedata
from collections.abc import Iterable

import numpy as np
import regex

#: The pattern that splits text before the merges of the rank files (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_exact = regex.compile(PATTERN)
# The same split with the standard engine, right for texts without the characters below.
_quick = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")


def _odd_characters() -> frozenset[str]:
    """Characters on which ``re`` and Unicode properties differ: other numerals, unassigned ones."""
    return frozenset(chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Nl", "No", "Cn"))


_separators = re.compile("[\x1c-\x1f]")
_odd = None


def split_words(text: str) -> list[str]:
    """The pre-tokens of ``text``; joined again they give ``text``."""
    global _odd
    if not text.isascii():
        if _odd is None:
            _odd = _odd_characters()
        if not _odd.isdisjoint(text) or _separators.search(text):
            return _exact.findall(text)
    elif _separators.search(text):
        return _exact.findall(text)
    return _quick.findall(text)


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte sequences and their ids from a rank file (base64 token, id)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token by exact byte-pair merging: the lowest rank first, leftmost on ties.

    A heap over neighbouring pairs keeps a word of n bytes at O(n log n), so texts without any
    break stay affordable.
    """
    if (whole := ranks.get(word)) is not None:
        return [whole]
    part = [word[i : i + 1] for i in range(len(word))]
    after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
    heap = [(r, i, part[i], part[i + 1]) for i in range(len(part) - 1) if (r := ranks.get(part[i] + part[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if part[i] != left or j >= len(part) or part[j] != right:
            continue
        part[i], part[j] = left + right, b""
        after[i] = k = after[j]
        if k < len(part):
            before[k] = i
            if (r := ranks.get(part[i] + part[k])) is not None:
                heapq.heappush(heap, (r, i, part[i], part[k]))
        if (h := before[i]) >= 0 and (r := ranks.get(part[h] + part[i])) is not None:
            heapq.heappush(heap, (r, h, part[h], part[i]))
    return [ranks[p] for p in part if p]


def compile_lexicon(words: Iterable[str], ranks: dict[bytes, int]) -> bytes:
    """The minimal automaton of ``words`` with their ids, as the bytes of one ``.npy`` array."""
    keys = sorted({w.encode() for w in words if w})
    nodes: list[dict[int, int]] = [{}]
    final: list[bool] = [False]
    register: dict[tuple, int] = {}
    path: list[int] = [0]

    def settle(depth: int, last: bytes) -> None:
        """Share the suffix of the previous word below ``depth`` with equal states."""
        while len(path) > depth + 1:
            child = path.pop()
            form = (final[child], tuple(sorted(nodes[child].items())))
            nodes[path[-1]][last[len(path) - 1]] = register.setdefault(form, child)

    last = b""
    for key in keys:
        same = 0
        while same < min(len(last), len(key)) and last[same] == key[same]:
            same += 1
        settle(same, last)
        for byte in key[same:]:
            nodes.append({})
            final.append(False)
            nodes[path[-1]][byte] = len(nodes) - 1
            path.append(len(nodes) - 1)
        final[path[-1]] = True
        last = key
    settle(0, last)

    number: dict[int, int] = {0: 0}
    order = [0]
    for state in order:
        for _, to in sorted(nodes[state].items()):
            if to not in number:
                number[to] = len(order)
                order.append(to)
    below: dict[int, int] = {}

    def size(root: int) -> int:
        todo = [root]
        while todo:
            state = todo[-1]
            wait = [t for t in nodes[state].values() if t not in below]
            if wait:
                todo.extend(wait)
            else:
                below[state] = final[state] + sum(below[t] for t in nodes[state].values())
                todo.pop()
        return below[root]

    size(0)
    edge, target, skip = [], [], []
    for state in order:
        passed = int(final[state])
        for byte, to in sorted(nodes[state].items()):
            edge.append(number[state] * 256 + byte)
            target.append(number[to])
            skip.append(passed)
            passed += below[to]
    ids = [merge(k, ranks) for k in keys]
    starts = np.cumsum([0, *map(len, ids)])
    parts = [np.asarray(x, dtype=np.int64) for x in (edge, target, skip, [final[s] for s in order], starts, [i for x in ids for i in x])]
    out = io.BytesIO()
    np.save(out, np.concatenate([np.array([len(p) for p in parts], dtype=np.int64), *parts]))
    return out.getvalue()


class Lexicon:
    """A compiled lexicon, mapped into memory."""

    def __init__(self, path: str):
        whole = np.load(path, mmap_mode="r")
        cuts = np.cumsum([6, *whole[:6]])
        self.edge, self.target, self.skip, self.final, self.starts, self.ids = (whole[a:b] for a, b in zip(cuts, cuts[1:]))

    def rank(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 where the automaton does not accept it."""
        if not len(self.edge):
            return np.full(len(words), -1)
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        text = np.frombuffer(b"".join(words), dtype=np.uint8)
        begin = np.cumsum(length) - length
        state, rank = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        live, at = np.flatnonzero(length > 0), 0
        state[length == 0] = -1
        while len(live):
            key = state[live] * 256 + text[begin[live] + at]
            pos = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            hit = self.edge[pos] == key
            state[live[~hit]] = -1
            live, pos = live[hit], pos[hit]
            state[live] = self.target[pos]
            rank[live] += self.skip[pos]
            at += 1
            live = live[length[live] > at]
        return np.where((state >= 0) & (self.final[np.maximum(state, 0)] == 1), rank, -1)


class Encoder:
    """Encodes texts in batches: automaton first, exact merging for words it does not hold.

    Words met before in this task are answered from a cache, which is emptied at ``cache_words``.
    """

    def __init__(self, lexicon: Lexicon, ranks: dict[bytes, int], cache_words: int = 400_000):
        self.lexicon, self.ranks, self.limit = lexicon, ranks, cache_words
        self._clear()

    def _clear(self) -> None:
        fresh: list[str] = []

        class Places(dict):
            def __missing__(self, word):
                self[word] = place = len(self)
                fresh.append(word)
                return place

        self.places, self.fresh = Places(), fresh
        self.ids, self.begin, self.length = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self) -> None:
        """Look up the words that came up for the first time."""
        if not self.fresh:
            return
        words = [w.encode("utf-8", "surrogatepass") for w in self.fresh]
        self.fresh.clear()
        rank = self.lexicon.rank(words)
        known = np.maximum(rank, 0)
        starts = self.lexicon.starts
        length = np.where(rank >= 0, starts[np.minimum(known + 1, len(starts) - 1)] - starts[np.minimum(known, len(starts) - 1)], 0)
        rest = {i: merge(words[i], self.ranks) for i in np.flatnonzero(rank < 0)}
        for i, ids in rest.items():
            length[i] = len(ids)
        begin = np.cumsum(length) - length
        out = np.empty(int(length.sum()), dtype=np.int32)
        held = np.flatnonzero(rank >= 0)
        if len(held):
            out[ragged(begin[held], length[held])] = self.lexicon.ids[ragged(np.asarray(starts[rank[held]]), length[held])]
        for i, ids in rest.items():
            out[begin[i] : begin[i] + len(ids)] = ids
        self.begin = np.concatenate([self.begin, begin + len(self.ids)])
        self.length = np.concatenate([self.length, length])
        self.ids = np.concatenate([self.ids, out])

    def encode(self, texts: list[str | None], ids: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """Number of ids of each text and, if asked for, all ids in a row."""
        if len(self.places) > self.limit:
            self._clear()
        split = [split_words(t) if t else () for t in texts]
        per_text = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        flat = [w for words in split for w in words]
        place = np.fromiter(map(self.places.__getitem__, flat), dtype=np.int64, count=len(flat))
        self._learn()
        length = self.length[place]
        ends = np.concatenate([[0], np.cumsum(length)])
        stops = np.cumsum(per_text)
        count = ends[stops] - ends[stops - per_text]
        return count, self.ids[ragged(self.begin[place], length)] if ids else None


def ragged(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The positions begin..begin+length-1 of every run, in a row."""
    total = int(length.sum())
    if not total:
        return np.empty(0, dtype=np.int64)
    shift = np.repeat(begin - (np.cumsum(length) - length), length)
    return shift + np.arange(total)
