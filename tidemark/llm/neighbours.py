"""The most similar vectors of every vector, by vantage-point trees.

The upper levels of one vantage-point tree are fitted on a bounded sample (``sample_rows``) and
shared; their leaves are the shards. Every vector is indexed in exactly one shard and sent as a
query to each shard that the triangle inequality cannot rule out: with radius r (from
``min_cosine``) the other side of a node is skipped if the query lies farther than ``factor * r``
from the node's sphere. A shard of more than ``local_rows`` members (the shared tree is bounded, a
table is not) builds a tree of its own. Inside a leaf, blocks of members ordered by their distance to a
vantage point are skipped by the same rule with twice the margin (both sides of a pair meet
there at once, while routing has a try from either side). ``factor`` 1 restores exact search; smaller factors
skip more. A pair counts whichever of its two sides finds it, so what is lost lies beyond twice the
margin.

Vectors travel as 64-byte codes; the error of a code's cosine is far below ``CODE_ERROR``, all
candidates within it are kept, and the cosines that count are taken from the given vectors.
Equal vectors form one class that is indexed once; its members take part with their six (k + 1)
smallest ids, which is all that the k best of any vector can hold.

Defined results: vectors that are null, of another length, with null, NaN or infinite values or all
zero are no vectors; a null id is left out; of several vectors under one id the one with the smallest
hash counts; of equal cosines (9 digits) the smaller id is nearer; an empty table gives no pairs;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import stage, table

CODE_ERROR = 0.008
_STEP = 2048


def _codes(dim: int):
    """(id, key, code): a 64-bit hash of the direction and its values as signed bytes.

    Directions that share a hash by chance would be taken for copies: odds of about 3 % that this
    happens anywhere among a billion vectors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            v /= np.abs(v).max(1, keepdims=True)
            v /= np.sqrt((v * v).sum(1, keepdims=True))
            rows = np.ascontiguousarray(v.astype(np.float32))
            key = np.fromiter((xxhash.xxh3_64_intdigest(r) for r in rows), dtype=np.uint64, count=len(rows)).view(np.int64)
            q = np.rint(v * (127 / np.abs(v).max(1, keepdims=True))).astype(np.int8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key), pa.array([r.tobytes() for r in q], pa.binary())], ["id", "key", "code"])

    return run


def _decode(codes: list[bytes], dim: int) -> np.ndarray:
    v = np.frombuffer(b"".join(codes), dtype=np.int8).reshape(-1, dim).astype(np.float32)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


class VantageTree:
    """Upper levels of a vantage-point tree; node i has its inside at 2i+1 and its outside at 2i+2."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int = 11, least: int = 8):
        rng = np.random.default_rng(seed)
        n = (1 << depth) - 1
        self.depth, self.point, self.mid = depth, np.zeros((n, sample.shape[1]), dtype=np.float32), np.full(n, np.nan, dtype=np.float32)
        at = {0: np.arange(len(sample))}
        for node in range(n):
            own = at.pop(node, None)
            if own is None or len(own) < 2 * least:
                continue
            # the vantage point with the widest spread of distances prunes best
            tries = sample[rng.choice(own, min(32, len(own)), replace=False)]
            some = sample[rng.choice(own, min(1024, len(own)), replace=False)]
            self.point[node] = tries[np.argmax(_distance(some @ tries.T).std(0))]
            d = _distance(sample[own] @ self.point[node])
            self.mid[node] = np.median(d)
            at[2 * node + 1], at[2 * node + 2] = own[d <= self.mid[node]], own[d > self.mid[node]]

    def route(self, v: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, own): the leaves to search for every vector and the one that it is kept in."""
        row, node, own = np.arange(len(v)), np.zeros(len(v), dtype=np.int64), np.ones(len(v), dtype=bool)
        done = []
        while len(row):
            leaf = node >= len(self.mid)
            leaf[~leaf] = np.isnan(self.mid[node[~leaf]])
            done.append((row[leaf], node[leaf], own[leaf]))
            row, node, own = row[~leaf], node[~leaf], own[~leaf]
            if not len(row):
                break
            gap = _distance(np.einsum("ij,ij->i", v[row], self.point[node])) - self.mid[node]
            both = np.abs(gap) <= margin
            inside, outside = 2 * node + 1, 2 * node + 2
            main, other = np.where(gap <= 0, inside, outside), np.where(gap <= 0, outside, inside)
            row, node, own = np.concatenate([row, row[both]]), np.concatenate([main, other[both]]), np.concatenate([own, np.zeros(int(both.sum()), dtype=bool)])
        return tuple(np.concatenate(x) for x in zip(*done)) if done else (row, node, own)


def _distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


def _routed(tree, dim: int, margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tree.value
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                part = batch.slice(at, _STEP)
                row, leaf, own = t.route(_decode(part.column(1).to_pylist(), dim), margin)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), pa.array(own), part.column(0).take(take), part.column(1).take(take)], ["leaf", "own", "key", "code"])

    return run


def _search(dim: int, k: int, min_cosine: float, margin: float, local_rows: int):
    """In one shard: for every query the members near enough to be among its k best."""
    least = min_cosine - CODE_ERROR

    def compare(v: np.ndarray, queries: np.ndarray, members: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of queries and members in the order of their distance to a common vantage point."""
        if not len(members):
            return
        far = _distance(v @ v[members[0]])
        members, place = members[np.argsort(far[members])], np.full(len(v), -1)
        queries = queries[np.argsort(far[queries])]
        for q0 in range(0, len(queries), 512):
            q = queries[q0 : q0 + 512]
            lo, hi = np.searchsorted(far[members], [far[q[0]] - 2 * margin, far[q[-1]] + 2 * margin], side="left")
            for m0 in range(lo, hi, 4096):
                m = members[m0 : min(m0 + 4096, hi)]
                c = v[q] @ v[m].T
                place[m] = np.arange(len(m))
                known = np.flatnonzero(place[q] >= 0)
                c[known, place[q[known]]] = -2  # a vector is no neighbour of its own
                place[m] = -1
                i, j = np.nonzero(c >= least)
                # beyond the k best of this block by more than the codes' error: never among the k best
                count = np.bincount(i, minlength=len(q))
                if c.shape[1] > k and (count > k).any():
                    kth = np.partition(c, c.shape[1] - k, axis=1)[:, c.shape[1] - k]
                    keep = c[i, j] >= kth[i] - 2 * CODE_ERROR
                    i, j = i[keep], j[keep]
                yield q[i], m[j]

    def run(data: pa.Table) -> pa.Table:
        own = data.column("own").to_numpy()
        v, key = _decode(data.column("code").to_pylist(), dim), data.column("key").combine_chunks()
        members, found = np.flatnonzero(own), [(np.empty(0, np.int64),) * 2]
        if len(members) <= local_rows:
            found += compare(v, np.arange(len(v)), members)
        else:  # a large shard has a tree of its own
            tree = VantageTree(v[members], math.ceil(math.log2(2 * len(members) / local_rows)))
            row, leaf, home = tree.route(v, margin)
            order = np.argsort(leaf, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1):
                found += compare(v, row[part], row[part][home[part] & own[row[part]]])
        a, b = (np.concatenate(x) for x in zip(*found))
        return pa.table({"a": key.take(pa.array(a)), "b": key.take(pa.array(b))})

    return run


def nearest_pairs(rows: DataFrame, key: str, vector: str, dim: int = 64, k: int = 5, min_cosine: float = 0.9, factor: float = 0.11, shard_rows: int = 1024, sample_rows: int = 65_536, local_rows: int = 4096) -> DataFrame:
    """(a, b, cosine), a < b: pairs of ids at or above ``min_cosine`` of which one is among the ``k``
    nearest of the other. At most ``sample_rows`` codes (64 bytes each) and a tree of as many bytes
    reach the driver and are broadcast, whatever the table holds."""
    spark = rows.sparkSession
    e = F.col(vector)
    proper = (F.size(e) == dim) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    given = rows.where(F.col(key).isNotNull() & e.isNotNull()).where(F.coalesce(proper, F.lit(False))).select(F.col(key).alias("id"), e.alias("v"))
    kind = given.schema["id"].dataType.simpleString()
    coded = given.mapInArrow(_codes(dim), f"id {kind}, key long, code binary")
    coded = stage(coded.groupBy("id").agg(F.min(F.struct("key", "code")).alias("c")).select("id", "c.*"), "coded")

    # members of a class, and the k + 1 smallest ids of each class: first in salted parts of it
    salt = F.pmod(F.xxhash64("id"), F.lit(64))
    part = coded.select("key", "id", salt.alias("salt")).withColumn("n", F.row_number().over(Window.partitionBy("key", "salt").orderBy("id"))).where(F.col("n") <= k + 1)
    first = part.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("n") <= k + 1).select("key", "id", "n")
    first = stage(first, "first")
    classes = stage(coded.groupBy("key").agg(F.first("code").alias("code")), "vectors")

    n = classes.count()
    each = max(1, math.ceil(n / sample_rows))
    sample = [r.code for r in classes.where(F.pmod(F.xxhash64("key"), F.lit(each)) == 0).limit(2 * sample_rows).select("code").collect()]
    depth = max(0, min(math.ceil(math.log2(max(1, n / shard_rows))), 13))
    points = _decode(sample, dim) if sample else np.zeros((0, dim), dtype=np.float32)
    tree = spark.sparkContext.broadcast(VantageTree(points, depth))
    margin = factor * math.sqrt(2 - 2 * (min_cosine - CODE_ERROR))
    routed = classes.select("key", "code").mapInArrow(_routed(tree, dim, margin), "leaf int, own boolean, key long, code binary")
    near = routed.groupBy("leaf").applyInArrow(_search(dim, k, min_cosine, margin, local_rows), "a long, b long")
    pairs = stage(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")

    # exact cosines from the given vectors of one id per class
    ends = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    wanted = first.where("n = 1").join(ends, "key").select("key", "id")
    unit = given.join(wanted, "id").groupBy("key").agg(F.min("v").alias("v")).select("key", F.col("v").cast("array<double>").alias("v"))
    unit = stage(unit, "exact")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    both = pairs.join(unit.select(F.col("key").alias("a"), F.col("v").alias("va")), "a").join(unit.select(F.col("key").alias("b"), F.col("v").alias("vb")), "b")
    both = both.withColumn("cosine", F.round(dot(F.col("va"), F.col("vb")) / F.sqrt(dot(F.col("va"), F.col("va")) * dot(F.col("vb"), F.col("vb"))), 9)).where(F.col("cosine") >= min_cosine).select("a", "b", "cosine")
    both = stage(both, "cosines")

    # members against the smallest ids of the near classes and of their own
    way = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))
    shared = first.where("n = 2").select(F.col("key").alias("a"), F.col("key").alias("b"), F.lit(1.0).alias("cosine"))
    to = way.unionByName(shared).join(first.select(F.col("key").alias("b"), F.col("id").alias("other")), "b").select(F.col("a").alias("key"), "other", "cosine")
    to = to.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("cosine"), "other"))).where(F.col("r") <= k + 1)
    ranked = coded.select("key", "id").join(to, "key").where("id <> other")
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other"))).where(F.col("rank") <= k)
    return ranked.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "cosine").groupBy("a", "b").agg(F.max("cosine").alias("cosine"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks with cosine of at least 0.9 of which one is among the other's five nearest."""
    pairs = nearest_pairs(table(spark, sf_dir, "chunks"), "chunk_id", "embedding")
    return pairs.select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))
