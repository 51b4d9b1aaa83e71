"""Groups of texts that share most of their shingles, by an exact join of prefixes.

1. Rows with equal text form one class; all later work is on classes, copies are never paired
   inside the join.
2. Shingles are put in one order, the rare ones first. Frequencies are counted over all texts in
   2^22 buckets; they decide how much work there is, never which pairs are found.
3. Two texts of n and m shingles that reach the threshold t share at least t / (1 + t) * (n + m) of
   them, and all of these stand at or behind the first common one. So at place i of a text of n
   shingles only partners of up to (n - i) * (1 + t) / t - n shingles can be met for the first time;
   places that reach no partner of t * n shingles are left out. The rest, about half of the shingles
   at 0.5, meets in a join that pairs every two rows whose reaches hold the other's size.
4. A row brings a parity sketch of two to four bits a shingle (a shingle flips one bit). The Hamming
   distance of two sketches, the longer one folded, never exceeds the symmetric difference, so pairs
   beyond the largest difference that the threshold allows are dropped before they are written.
5. The order is handled in ``rounds`` parts, one after the other, so that only a part of the rows is on
   disk at once. Shingles of more than ``GROUP_ROWS`` classes are compared in blocks over many tasks.
6. What is left is verified on the texts themselves.

Every pair is found and nothing is capped. Where many texts share their rarest shingles the number of
compared pairs grows with the square of the texts that do; figures are in the README. ``exact=False``
takes XOR segments in place of the shingles (:func:`candidates`): less to compare, but a filter that
loses some pairs of texts that differ in many places.

Defined results: null and empty texts and texts of fewer than ``min_words`` words belong to no
class; a null id is left out; rows repeated under one id count once (under several texts the id
belongs to several classes); an empty table gives no pairs; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import stage, table

#: The longest runs of letters or digits.
WORD = re.compile(r"[^\W_]+")
_STEP = 1024
#: Words of the second sketch, wide enough for texts of several hundred shingles.
WIDE = 16
#: Frequent segments per shingle of a text from which on it counts as one of a large family.
FAMILY = 0.35
#: Words of the first sketch.
SHORT = 8
#: Up to so many short sketches (76 bytes each) go to every executor; beyond, they are joined by shuffles.
BROADCAST_ROWS = 500_000
_WORDS = [f"s{i}" for i in range(SHORT)]
#: Buckets in which shingles are counted.
BUCKETS = 1 << 22
#: Classes with one shingle that a single task compares; more are spread in blocks of a quarter of that.
GROUP_ROWS = 65_536
#: Pairs that are looked at together.
_PAIRS = 1 << 19
#: Stands for the key of a text where a segment is known to be frequent.
MARK = np.int64(-(1 << 63))


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), vectorised."""
    x = (x ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """For texts of at least ``k`` words: (text number, hash) of their distinct shingles, by text.

    At most 4,096 texts at once. Hashes only find candidates; texts are compared in the end.
    """
    flat, count = [], []
    for t in texts:
        words = WORD.findall(t.lower())
        count.append(len(words))
        flat += words
    known = dict.fromkeys(flat)
    place = dict(zip(known, range(len(known))))
    each = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in place), dtype=np.uint64, count=len(place))
    h, count = each[np.fromiter(map(place.__getitem__, flat), dtype=np.int64, count=len(flat))], np.asarray(count)
    doc = np.repeat(np.arange(len(texts)), count)
    if len(h) < k:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    whole = doc[: len(doc) - k + 1] == doc[k - 1 :]
    mixed = np.zeros(len(h) - k + 1, dtype=np.uint64)
    for i in range(k):
        mixed = _mix(mixed + h[i : len(h) - k + 1 + i], i + 1)
    doc, mixed = doc[: len(mixed)][whole], mixed[whole]
    # text number and 52 bits of the hash in one number: a plain sort, no permutation
    both = np.sort((doc.astype(np.uint64) << np.uint64(52)) | (mixed >> np.uint64(12)))
    both = both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both
    return (both >> np.uint64(52)).astype(np.int64), _mix(both & np.uint64((1 << 52) - 1), 0)


def _xor_runs(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """XOR of the values of each distinct key: (position of a row with the key, XOR)."""
    order = np.argsort(key)  # the order of equal keys does not matter
    key = key[order]
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    return order[begin], np.bitwise_xor.reduceat(value[order], begin) if len(begin) else value


def segments(doc: np.ndarray, h: np.ndarray, size: np.ndarray, density: float, cuts: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, segment signature) in the band of each text and in the one below, for several
    independent ways to cut the shingles into segments. The last bit is that of the band."""
    out = []
    for below, cut in ((b, c) for c in range(cuts) for b in (0, 1)):
        band = np.floor(np.log2(np.maximum(size, 1))).astype(np.int64) - below
        k = np.maximum(4, (density * 2.0 ** (band + 0.5)).astype(np.int64))
        slot = (_mix(h, 1000 + cut) >> np.uint64(11)) % k[doc].astype(np.uint64)
        at, xor = _xor_runs(doc.astype(np.uint64) * np.uint64(1 << 24) + slot, _mix(h, 1007))
        own = (band[doc[at]] + 2).astype(np.uint64)
        out.append((doc[at], (_mix(xor ^ own, 5 + cut) & ~np.uint64(1)) | (own & np.uint64(1))))
    return np.concatenate([d for d, _ in out]), np.concatenate([s for _, s in out])


def prefixes(doc: np.ndarray, h: np.ndarray, size: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle) of the shingles of which two texts at the threshold must share one."""
    h = _mix(h, 31)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    begin = np.r_[0, np.cumsum(size)[:-1]]
    first = np.arange(len(h)) - begin[doc] < (size - np.ceil(threshold * size - 1e-9) + 1)[doc]
    return doc[first], h[first]


def _salted(doc: np.ndarray, s: np.ndarray, key: np.ndarray, group_rows: int) -> pa.RecordBatch:
    """Rows (k1, sig, salt): segments that are frequent in this batch alone are spread by salt; a
    mark in their place tells the task of the segment that it is frequent."""
    sig, place, count = np.unique(s, return_inverse=True, return_counts=True)
    hot = count > group_rows
    salt = np.where(hot[place], 1 + doc % 63, 0)
    k, s = np.r_[key[doc], np.full(int(hot.sum()), MARK)], np.r_[s, sig[hot]]
    return pa.RecordBatch.from_arrays([pa.array(k), pa.array(s.view(np.int64)), pa.array(np.r_[salt, np.zeros(int(hot.sum()), np.int64)].astype(np.int8))], ["k1", "sig", "salt"])


def parity_sketch(doc: np.ndarray, h: np.ndarray, n: int, words: int) -> np.ndarray:
    """64 * ``words`` parity bits of each text: a shingle flips one bit."""
    bit = _mix(h, 77 + words) % np.uint64(64 * words)
    out = np.zeros((n, words), dtype=np.uint64)
    at, xor = _xor_runs(doc.astype(np.uint64) * np.uint64(words) + (bit >> np.uint64(6)), np.uint64(1) << (bit & np.uint64(63)))
    out[doc[at], (bit[at] >> np.uint64(6)).astype(np.int64)] = xor
    return out


def classes(rows: DataFrame, key: str, text: str, min_words: int) -> tuple[DataFrame, DataFrame]:
    """Members (id, k1, k2) and one text per class (k1, k2, text); k1, k2 are two hashes of the text."""
    t = F.col(text)
    long_enough = F.size(F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))) >= min_words
    r = rows.where(F.col(key).isNotNull() & t.isNotNull() & (F.length(t) >= 2 * min_words - 1) & long_enough)
    r = r.select(F.col(key).alias("id"), t.alias("text"), F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(1), t).alias("k2"))
    members = stage(r.select("id", "k1", "k2").distinct(), "members")
    texts = stage(r.groupBy("k1", "k2").agg(F.first("text").alias("text")), "texts")
    return members, texts


def _sketch_rows(k: int, cut, group_rows: int):
    """Per class its segments (k1, sig, salt), or without ``cut`` its sketches (k1, n, s0..s7, wide)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                part = batch.slice(at, _STEP)
                key = part.column(0).to_numpy(zero_copy_only=False)
                doc, h = shingle_hashes(part.column(1).to_pylist(), k)
                size = np.bincount(doc, minlength=len(key))
                if cut:
                    yield _salted(*cut(doc, h, size), key, group_rows)
                else:
                    words = parity_sketch(doc, h, len(key), SHORT).view(np.int64)
                    wide = pa.array([w.tobytes() for w in parity_sketch(doc, h, len(key), WIDE)], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(size.astype(np.int32)), *(pa.array(np.ascontiguousarray(words[:, i])) for i in range(SHORT)), wide], ["k1", "n", *_WORDS, "wide"])

    return run


def _meet(group_rows: int):
    """Over rows (sig, k1, salt) sorted by sig and k1: pairs inside small groups, rows of large groups as they are."""

    def finish(sig: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
        fresh = np.ones(len(sig), dtype=bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
        sig, key = sig[fresh], key[fresh]
        begin = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        count = np.diff(np.r_[begin, len(sig)])
        last = np.repeat(begin + count, count)
        many = np.repeat(np.where(key[begin] == MARK, group_rows + 1, count), count)
        at = np.flatnonzero((many > 1) & (many <= group_rows))
        step = 1
        while len(at := at[at + step < last[at]]):
            yield _rows(0, key[at], key[at + step])
            step += 1
        if len(big := np.flatnonzero((many > group_rows) & (key != MARK))):
            yield _rows(1, key[big], sig[big])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, key, big = np.empty(0, np.int64), np.empty(0, np.int64), None
        for batch in batches:
            s, k, salt = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if len(spread := np.flatnonzero(salt)):
                yield _rows(1, k[spread], s[spread])
                s, k = s[salt == 0], k[salt == 0]
            if big is not None and len(s):  # the group known to be large goes on
                n = int(np.searchsorted(s, big, side="right"))
                if n:
                    yield _rows(1, k[:n], s[:n])
                s, k = s[n:], k[n:]
                big = big if not len(s) else None
            sig, key = np.concatenate([sig, s]), np.concatenate([key, k])
            if not len(sig):
                continue
            edge = int(np.searchsorted(sig, sig[-1], side="left"))
            if edge:
                yield from finish(sig[:edge], key[:edge])
            sig, key = sig[edge:], key[edge:]
            if key[0] == MARK or len(np.unique(key)) > group_rows:
                big = int(sig[-1])
                yield _rows(1, key[key != MARK], sig[key != MARK])
                sig, key = sig[:0], key[:0]
        if len(sig):
            yield from finish(sig, key)

    return run


def _rows(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    if kind == 0:
        a, b = np.minimum(a, b), np.maximum(a, b)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, dtype=np.int8)), pa.array(a), pa.array(b)], ["kind", "a", "b"])


def _near(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the sketches leave room for the threshold. a, b: words of the sketches, last axis 4."""
    apart = np.bitwise_count(a ^ b).sum(-1)
    return (apart <= (na + nb) * (1 - threshold) / (1 + threshold) + 1e-9) & (np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9)


def _block_pairs(threshold: float, bound: bool):
    """All pairs of an asking (side 0) and a held row of one block, with ``bound`` those within the sketch bound."""

    def run(data: pa.Table) -> pa.Table:
        side, key = data.column("side").to_numpy(), data.column("k1").to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if bound:
            n = data.column("n").to_numpy()
            words = np.stack([data.column(c).to_numpy().view(np.uint64) for c in _WORDS], 1)
        a, b = [], []
        for at in range(0, len(left), 64):
            l = left[at : at + 64]
            ok = key[l][:, None] != key[right]
            if bound:
                ok &= _near(words[l][:, None], words[right], n[l][:, None], n[right], threshold)
            x, y = np.nonzero(ok)
            a.append(key[l[x]])
            b.append(key[right[y]])
        a, b = (np.concatenate([np.empty(0, np.int64), *x]) for x in (a, b))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def _in_blocks(asks: DataFrame, held: DataFrame, threshold: float, block_rows: int, sketch: DataFrame | None = None) -> DataFrame:
    """(a, b): pairs of rows (k1, sig) of ``asks`` and of ``held`` with one segment, within the bound of
    the sketches if they are given. The rows of a segment are spread over blocks of about
    ``block_rows`` on either side."""

    def width(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("sig").agg(F.ceil(F.count("*") / block_rows).cast("int").alias(name))

    widths = width(held, "wj").join(width(asks, "wi"), "sig")
    own = lambda w: F.pmod(F.xxhash64("k1", "sig"), F.col(w)).cast("int")
    every = lambda w: F.explode(F.sequence(F.lit(0), F.col(w) - 1))
    left = asks.join(widths, "sig").select("sig", own("wi").alias("i"), every("wj").alias("j"), F.lit(0).cast("byte").alias("side"), "k1")
    right = held.join(widths, "sig").select("sig", every("wi").alias("i"), own("wj").alias("j"), F.lit(1).cast("byte").alias("side"), "k1")
    both = left.unionByName(right)
    both = both if sketch is None else both.join(sketch, "k1")
    return both.groupBy("sig", "i", "j").applyInArrow(_block_pairs(threshold, sketch is not None), "a long, b long")


def shingle_levels(texts: DataFrame, shingle: int) -> np.ndarray:
    """Eighths of powers of two of the number of texts with a shingle, by bucket; one byte a bucket reaches the driver's table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, dtype=np.int32)
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                _, h = shingle_hashes(batch.column(0).slice(at, _STEP).to_pylist(), shingle)
                np.add.at(seen, (h >> np.uint64(42)).astype(np.int64), np.int32(1))
        some = np.flatnonzero(seen > 1)  # what a task saw once hardly moves the order
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[some].astype(np.int64))], ["bucket", "n"])

    sums = texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.round(8 * F.log2(F.sum("n") + 1)).cast("int").alias("level"))
    sums = sums.toArrow()  # at most one row a bucket
    levels = np.zeros(BUCKETS, dtype=np.uint8)
    levels[sums.column(0).to_numpy()] = np.minimum(sums.column(1).to_numpy(), 255)
    return levels


def reaches(doc: np.ndarray, h: np.ndarray, size: np.ndarray, levels: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, reach) of the places at which a text can meet a partner for the first
    time; the reach is the largest size of such a partner."""
    rank = (levels[(h >> np.uint64(42)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (_mix(h, 31) >> np.uint64(8))
    order = np.lexsort((rank, doc))
    doc, rank = doc[order], rank[order]
    begin, n = np.r_[0, np.cumsum(size)[:-1]], size[doc]
    left = n - (np.arange(len(doc)) - begin[doc])
    reach = np.floor(left * (1 + threshold) / threshold - n + 1e-6).astype(np.int64)
    keep = reach >= threshold * n - 1e-6
    return doc[keep], rank[keep], reach[keep]


def _sketch_words(n: np.ndarray) -> np.ndarray:
    """Words of the sketch of a text of n shingles: two to four bits a shingle, a power of two."""
    return (1 << np.ceil(np.log2(np.clip(n, 32, 32 * WIDE) / 32)).astype(np.int64)).astype(np.int64)


def _prefix_rows(k: int, shared, threshold: float, part: int, parts: int):
    """(sig, nl, k1, sketch) of one part of the shingles; nl holds the size of the text and the reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                rows = batch.slice(at, _STEP)
                key = rows.column(0).to_numpy(zero_copy_only=False)
                doc, h = shingle_hashes(rows.column(1).to_pylist(), k)
                size = np.bincount(doc, minlength=len(key))
                whole, words = parity_sketch(doc, h, len(key), WIDE), _sketch_words(size)
                sketch = np.empty(len(key), dtype=object)
                for w in np.unique(words):
                    own = np.flatnonzero(words == w)
                    sketch[own] = [x.tobytes() for x in np.bitwise_xor.reduce(whole[own].reshape(len(own), -1, w), 1)]
                doc, sig, reach = reaches(doc, h, size, shared.value, threshold)
                mine = np.flatnonzero(sig % np.uint64(parts) == part)
                doc, sig, reach = doc[mine], sig[mine], reach[mine]
                nl = size[doc] << 32 | reach
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(nl), pa.array(key[doc]), pa.array(sketch, pa.binary()).take(pa.array(doc))], ["sig", "nl", "k1", "sketch"])

    return run


class _Held:
    """Sketches of rows, at their own width and folded to half of it."""

    def __init__(self, sketch: pa.Array, n: np.ndarray):
        lengths = pc.binary_length(sketch).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = np.frombuffer(b"".join(sketch.to_pylist()), dtype=np.uint64)
        begin = np.r_[0, np.cumsum(lengths)[:-1]] >> 3
        self.words, self.n, self.of = lengths >> 3, n, {}
        for w in np.unique(self.words):
            at = np.flatnonzero(self.words == w)
            own = flat[begin[at, None] + np.arange(w)]
            self._put(int(w), at, own)
            if w > 1:
                self._put(int(w) // 2, at, own[:, : w // 2] ^ own[:, w // 2 :])

    def _put(self, w: int, at: np.ndarray, sketches: np.ndarray) -> None:
        place, held = self.of.get(w, (np.full(len(self.n), -1, dtype=np.int64), np.empty((0, w), np.uint64)))
        place[at] = len(held) + np.arange(len(at))
        self.of[w] = place, np.concatenate([held, sketches])

    def near(self, x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
        """Which pairs the sketches leave room for; x are the smaller texts."""
        room = (self.n[x] + self.n[y]) * (1 - threshold) / (1 + threshold) + 1e-9
        out = np.zeros(len(x), dtype=bool)
        for w in np.unique(self.words[x]):
            place, held = self.of[int(w)]
            at = np.flatnonzero(self.words[x] == w)
            out[at] = np.bitwise_count(held[place[x[at]]] ^ held[place[y[at]]]).sum(1, dtype=np.int32) <= room[at]
        return out


def _reach_pairs(sig: np.ndarray, nl: np.ndarray, key: np.ndarray, sketch: pa.Array, threshold: float, of: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys of the pairs of rows, sorted by sig and nl, that reach each other and whose sketches leave
    room; ``of`` gives the rows' block and the two blocks of which pairs are wanted."""
    if len(sig) < 2:
        return
    n, reach, held = nl >> 32, nl & 0xFFFFFFFF, None
    group = np.cumsum(np.r_[0, sig[1:] != sig[:-1]]) << 32
    first = np.arange(1, len(sig) + 1)
    count = np.maximum(np.searchsorted(group | n, group | reach, side="right") - first, 0)
    for rows in np.split(np.arange(len(sig)), np.searchsorted(np.cumsum(count), np.arange(_PAIRS, count.sum(), _PAIRS))):
        c = count[rows]
        x = np.repeat(rows, c)
        y = np.arange(len(x)) - np.repeat(np.cumsum(c) - c, c) + first[x]
        ok = reach[y] >= n[x]
        if of is not None and of[1] != of[2]:
            ok &= of[0][x] != of[0][y]
        x, y = x[ok], y[ok]
        if len(x):
            held = held or _Held(sketch, n)
            ok = held.near(x, y, threshold) & (key[x] != key[y])
            yield key[x[ok]], key[y[ok]]


_MET = "kind byte, a long, b long, nl long, sketch binary"


def _meet_prefixes(threshold: float, most: int):
    """Over rows (sig, nl, k1, sketch) sorted by sig and nl: pairs (kind 0: a, b), and the rows of
    shingles of more than ``most`` classes as they are (kind 1: a = k1, b = sig)."""

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        sig, nl, key = (t.column(i).to_numpy() for i in range(3))
        got = list(_reach_pairs(sig, nl, key, t.column(3).combine_chunks(), threshold))
        if got:
            a, b = (np.concatenate(x) for x in zip(*got))
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(both), np.int8)), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.nulls(len(both), pa.int64()), pa.nulls(len(both), pa.binary())], names)

    def many(t: pa.Table) -> Iterator[pa.RecordBatch]:
        for b in t.combine_chunks().to_batches():
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(b.num_rows, np.int8)), b.column(2), b.column(0), b.column(1), b.column(3)], names)

    names = ["kind", "a", "b", "nl", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []  # rows of the last shingle so far
        held, big = 0, None
        for batch in batches:
            sig = batch.column(0).to_numpy(zero_copy_only=False)
            if big is not None:
                n = int(np.searchsorted(sig, big, side="right"))
                yield from many(pa.Table.from_batches([batch.slice(0, n)]))
                batch, sig = batch.slice(n), sig[n:]
                if not len(sig):
                    continue
                big = None
            edge = int(np.searchsorted(sig, sig[-1], side="left")) if len(sig) else 0
            if kept and len(sig) and kept[-1].column(0)[0].as_py() != sig[0] and not edge:
                yield from pairs(pa.Table.from_batches(kept))
                kept, held = [], 0
            elif edge:
                yield from pairs(pa.Table.from_batches([*kept, batch.slice(0, edge)]))
                kept, held = [], 0
            if batch.num_rows > edge:
                kept.append(batch.slice(edge))
                held += batch.num_rows - edge
            if held > most:
                big = kept[-1].column(0)[0].as_py()
                yield from many(pa.Table.from_batches(kept))
                kept, held = [], 0
        if kept:
            yield from pairs(pa.Table.from_batches(kept))

    return run


def _prefix_blocks(rows: DataFrame, threshold: float, block_rows: int) -> DataFrame:
    """(a, b) within shingles of many classes, whose rows (sig, nl, k1, sketch) are spread over blocks;
    every two blocks of a shingle meet in one group."""
    widths = rows.groupBy("sig").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("w"))
    own = rows.join(widths, "sig").withColumn("own", F.pmod(F.xxhash64("k1", "sig"), F.col("w")).cast("int"))
    each = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("w") - 1)))
    each = each.select("sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "nl", "k1", "sketch")

    def meet(data: pa.Table) -> pa.Table:
        data = data.sort_by("nl")
        sig, i, j, own, nl, key = (data.column(c).to_numpy() for c in ("sig", "i", "j", "own", "nl", "k1"))
        got = list(_reach_pairs(sig, nl, key, data.column("sketch").combine_chunks(), threshold, (own, i[0], j[0])))
        a, b = (np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*got) if got else ((), ())))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return each.groupBy("sig", "i", "j").applyInArrow(meet, "a long, b long")


def exact_candidates(texts: DataFrame, shingle: int, threshold: float, rounds: int) -> DataFrame:
    """(a, b): classes (by k1) that share a shingle within reach of both and whose sketches leave room:
    all pairs at or above the threshold are among them."""
    spark, base = texts.sparkSession, texts.select("k1", "text")
    shared = spark.sparkContext.broadcast(shingle_levels(base, shingle))
    found = None
    for part in range(rounds):
        rows = base.mapInArrow(_prefix_rows(shingle, shared, threshold, part, rounds), "sig long, nl long, k1 long, sketch binary")
        met = stage(rows.repartition("sig").sortWithinPartitions("sig", "nl").mapInArrow(_meet_prefixes(threshold, GROUP_ROWS), _MET), "met")
        spark.sparkContext._jvm.System.gc()  # rows of this part go from the disk before the next are written
        pairs = met.where("kind = 0").select("a", "b")
        big = met.where("kind = 1")
        if not big.isEmpty():
            big = big.select(F.col("b").alias("sig"), "nl", F.col("a").alias("k1"), "sketch")
            pairs = pairs.unionByName(stage(_prefix_blocks(big, threshold, max(1, GROUP_ROWS // 4)), "blocks"))
        found = pairs if found is None else found.unionByName(pairs)
    return found.distinct()


def candidates(texts: DataFrame, shingle: int, threshold: float, density: float, cuts: int, group_rows: int, rounds: int, ahead: int = 2, exact: bool = False, block_rows: int = 512) -> DataFrame:
    """(a, b): classes (by k1) whose segments meet and whose sketches allow the threshold."""
    base = texts.select("k1", "text")

    def cut(doc: np.ndarray, h: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return prefixes(doc, h, size, threshold) if exact else segments(doc, h, size, density, cuts)

    rows = base.mapInArrow(_sketch_rows(shingle, cut, group_rows), "k1 long, sig long, salt byte")
    sketch = stage(base.mapInArrow(_sketch_rows(shingle, None, group_rows), f"k1 long, n int, {', '.join(f'{w} long' for w in _WORDS)}, wide binary"), "sketch")
    small = sketch.count() <= BROADCAST_ROWS
    short = sketch.drop("wide")
    ends = [short.select(F.col("k1").alias(x), *[F.col(c).alias(x + c) for c in ("n", *_WORDS)]) for x in "ab"]
    apart = sum((F.bit_count(F.col(f"a{w}").bitwiseXOR(F.col(f"b{w}"))) for w in _WORDS), F.lit(0))
    room = (F.col("an") + F.col("bn")) * ((1 - threshold) / (1 + threshold)) + 1e-9
    near = (F.least("an", "bn") >= F.greatest("an", "bn") * threshold - 1e-9) & (apart <= room)

    def bounded(pairs: DataFrame) -> DataFrame:
        """Pairs within the bound of the short sketches."""
        if small:
            return pairs.join(F.broadcast(ends[0]), "a").join(F.broadcast(ends[1]), "b").where(near).select("a", "b")
        # one shuffle serves the distinct and the first join
        return pairs.repartition("a").distinct().join(ends[0], "a").join(ends[1], "b").where(near).select("a", "b")

    found = []
    for r in range(1 if exact else rounds):
        met = rows.select("sig", "k1", "salt").repartition("sig", "salt").sortWithinPartitions("sig", "k1").mapInArrow(_meet(group_rows), "kind byte, a long, b long")
        if small:  # pairs are dropped before they are written anywhere
            met = met.join(F.broadcast(ends[0]), "a", "left").join(F.broadcast(ends[1]), "b", "left").where((F.col("kind") == 1) | near).select("kind", "a", "b")
        met = stage(met, "met")
        pairs = met.where("kind = 0").select("a", "b")
        found.append(pairs if small else bounded(pairs))
        big = met.where("kind = 1").select(F.col("a").alias("k1"), F.col("b").alias("sig"))
        if big.isEmpty():
            break
        if exact or r == rounds - 1:
            found.append(_in_blocks(big, big, threshold, block_rows, F.broadcast(short) if small else short))
            break
        by = Window.partitionBy("k1", "band").orderBy("sig")
        of_band = Window.partitionBy("k1", "band")
        each = big.join(sketch.select("k1", "n"), "k1").withColumn("band", F.col("sig").bitwiseAND(1)).withColumn("many", F.count("*").over(of_band))
        following = F.array_compact(F.array(*[F.lead("sig", i).over(by) for i in range(1, ahead + 1)]))
        each = stage(each.select("k1", "sig", "band", "many", (F.col("many") >= FAMILY * F.col("n")).alias("family"), following.alias("next")), "frequent")
        held = each.select("k1", "sig")
        found.append(bounded(_in_blocks(each.where("many = 1 AND NOT family").select("k1", "sig"), held, threshold, block_rows)))
        found.append(_in_blocks(each.where("family").select("k1", "sig"), held, threshold, block_rows, short))
        rows = each.where("NOT family").select("k1", "band", "sig", F.explode("next").alias("other")).where("sig <> other")
        rows = rows.select("k1", F.xxhash64("sig", "other").bitwiseAND(-2).bitwiseOR(F.col("band")).alias("sig"), F.lit(0).cast("byte").alias("salt"))
    both = found[0]
    for more in found[1:]:
        both = both.unionByName(more)
    both = both.distinct()
    both = stage(both, "rough")
    wide = sketch.select("k1", "n", "wide")
    both = both.join(wide.select(F.col("k1").alias("a"), F.col("n").alias("an"), F.col("wide").alias("aw")), "a").join(wide.select(F.col("k1").alias("b"), F.col("n").alias("bn"), F.col("wide").alias("bw")), "b")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint64).reshape(-1, WIDE) for i in (4, 5))
            ok = pa.array(_near(a, b, batch.column(2).to_numpy(), batch.column(3).to_numpy(), threshold))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])

    return both.select("a", "b", "an", "bn", "aw", "bw").mapInArrow(bound, "a long, b long")


def similar_classes(texts: DataFrame, shingle: int = 5, threshold: float = 0.8, density: float = 0.4, cuts: int = 2, group_rows: int = 32, rounds: int = 3, exact: bool = True) -> DataFrame:
    """(k1, k2, l1, l2, similarity): pairs of classes at or above the threshold, verified on the texts."""
    if threshold < 0.5:
        raise ValueError("bands of factor two hold pairs of similarity 0.5 and more")
    pairs = exact_candidates(texts, shingle, threshold, rounds) if exact else candidates(texts, shingle, threshold, density, cuts, group_rows, rounds)
    pairs = stage(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("k1")).union(pairs.select(F.col("b").alias("k1"))).distinct()
    text = stage(texts.join(wanted, "k1", "left_semi"), "paired")
    left = pairs.join(text.select(F.col("k1").alias("a"), F.col("k2").alias("a2"), F.col("text").alias("at")), "a")
    both = left.join(text.select(F.col("k1").alias("b"), F.col("k2").alias("b2"), F.col("text").alias("bt")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, frozenset] = {}

        def shingles(t: str) -> frozenset:
            if (s := kept.get(t)) is None:
                if len(kept) > 4000:
                    kept.clear()
                words = WORD.findall(t.lower())
                s = kept[t] = frozenset(zip(*(words[i:] for i in range(shingle))))
            return s

        for batch in batches:
            share = []
            for a, b in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                x, y = shingles(a), shingles(b)
                common = len(x & y)
                share.append(common / max(1, len(x) + len(y) - common))
            keep = np.asarray(share) >= threshold
            yield pa.RecordBatch.from_arrays([*(batch.column(i).filter(pa.array(keep)) for i in range(4)), pa.array(np.asarray(share)[keep])], ["k1", "k2", "l1", "l2", "similarity"])

    return both.select("a", "a2", "b", "b2", "at", "bt").mapInArrow(verify, "k1 long, k2 long, l1 long, l2 long, similarity double")


def near_pairs(rows: DataFrame, key: str, text: str, min_words: int = 5, hubs: int = 64, **options) -> DataFrame:
    """(a, b): ids of different rows at or above the threshold, smaller id first, copies included.

    All pairs of n equal texts would be n * n / 2 rows: a pair is listed if at least one of the two
    is among the ``hubs`` smallest ids of its class of equal texts. So classes of up to ``hubs`` + 1
    copies have all their pairs, larger ones stay connected, and no link between texts is lost;
    :func:`near_groups` tells the class and the group of every id.
    """
    members, texts = classes(rows, key, text, min_words)
    links = similar_classes(texts, **options)
    large = members.groupBy("k1", "k2").agg(F.count("*").alias("n")).where(F.col("n") > hubs).select("k1", "k2")
    salted = members.join(large, ["k1", "k2"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    least = lambda df, *by: df.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("r") <= hubs)
    heads = least(least(salted, "k1", "k2", "salt"), "k1", "k2").select("k1", "k2", "id", F.lit(True).alias("hub"))
    several = members.groupBy("id").agg((F.count("*") > 1).alias("several"))  # ids under more than one text
    marked = members.join(large.withColumn("large", F.lit(True)), ["k1", "k2"], "left").join(heads, ["k1", "k2", "id"], "left").join(several, "id")
    m = stage(marked.select("id", "k1", "k2", (F.col("large").isNull() | F.col("hub").isNotNull()).alias("hub"), "several"), "marked")
    links = stage(links.select("k1", "k2", "l1", "l2"), "links")

    def every(left: DataFrame, right: DataFrame) -> DataFrame:
        """Pairs of an id of ``left`` and one of ``right``, each once a pair of classes."""
        to = right.select(F.col("id").alias("other"), F.col("k1").alias("l1"), F.col("k2").alias("l2"), F.col("hub").alias("too"))
        linked = links.join(left, ["k1", "k2"]).join(to, ["l1", "l2"]).where("hub OR too")
        equal = left.where("hub").join(to.withColumnsRenamed({"l1": "k1", "l2": "k2"}), ["k1", "k2"]).where("id < other OR NOT too")
        both = linked.select("id", "other").unionByName(equal.select("id", "other")).where("id <> other")
        return both.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))

    one, more = m.where("NOT several"), m.where("several")
    # only ids under several texts can meet twice: all other pairs are written without a shuffle
    again = every(more, m).unionByName(every(one, more))
    return every(one, one).unionByName(again.distinct())


def near_classes(rows: DataFrame, key: str, text: str, min_words: int = 5, **options) -> DataFrame:
    """One row per id: (id, class_id, copies, links): its class of equal texts, the ids in it and the
    number of other classes that are near."""
    members, texts = classes(rows, key, text, min_words)
    links = similar_classes(texts, **options)
    ends = links.select("k1", "k2").unionAll(links.select(F.col("l1").alias("k1"), F.col("l2").alias("k2"))).groupBy("k1", "k2").agg(F.count("*").alias("links"))
    sizes = members.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min("id").alias("class_id"))
    return members.join(sizes, ["k1", "k2"]).join(ends, ["k1", "k2"], "left").select("id", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))


def components(edges: DataFrame) -> DataFrame:
    """(id, group_id): every end of the edges (a, b) with the smallest id it is connected to.

    Large stars and small stars take turns: neighbours above a node are hung below the smallest
    neighbour, then those below it, until nothing moves (about log n turns).
    """
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()  # two numbers
        if state == before:
            return now.select(F.col("u").alias("id"), F.col("v").alias("group_id")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("group_id"))).groupBy("id").agg(F.min("group_id").alias("group_id"))
        before = state
        ways = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = ways.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stage(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u")
        small = hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = stage(small.distinct(), "edges")


def near_groups(rows: DataFrame, key: str, text: str, min_words: int = 5, **options) -> DataFrame:
    """One row per id: (id, class_id, group_id, copies, links). A group holds all classes of equal
    texts that are linked by near pairs, directly or over others; its id is the smallest in it."""
    members, texts = classes(rows, key, text, min_words)
    links = stage(similar_classes(texts, **options).select("k1", "k2", "l1", "l2"), "links")
    sizes = stage(members.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min("id").alias("class_id")), "sizes")
    head = sizes.select("k1", "k2", F.col("class_id").alias("a"))
    other = sizes.select(F.col("k1").alias("l1"), F.col("k2").alias("l2"), F.col("class_id").alias("b"))
    edges = stage(links.join(head, ["k1", "k2"]).join(other, ["l1", "l2"]).select("a", "b"), "links")
    count = edges.select("a").unionAll(edges.select(F.col("b").alias("a"))).groupBy(F.col("a").alias("class_id")).agg(F.count("*").alias("links"))
    of_class = sizes.join(components(edges).withColumnRenamed("id", "class_id"), "class_id", "left").join(count, "class_id", "left")
    of_class = of_class.select("k1", "k2", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
    return members.join(of_class, ["k1", "k2"]).select("id", "class_id", "group_id", "copies", "links")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks of at least 30 words whose sets of three words in a row overlap by half."""
    pairs = near_pairs(table(spark, sf_dir, "chunks"), "chunk_id", "content", min_words=30, shingle=3, threshold=0.5)
    return pairs.select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with their class of equal texts and the number of near classes (five words, 0.8)."""
    c = near_classes(table(spark, sf_dir, "chunks"), "chunk_id", "content")
    return c.select(F.col("id").alias("chunk_id"), "class_id", "copies", "links")


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with their class of equal texts and their group of near texts, by the measure of p3_found."""
    g = near_groups(table(spark, sf_dir, "chunks"), "chunk_id", "content", min_words=30, shingle=3, threshold=0.5)
    return g.withColumnRenamed("id", "chunk_id")
