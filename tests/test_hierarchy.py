"""Hierarchies against a plain walk, and their edge cases."""

import random
from datetime import datetime, timedelta

import pytest

from tidemark.operators.hierarchy import SEP, WeightedForest, chain_tops, descendants, hierarchy

SCHEMA = "connection_id string, item_id string, is_folder boolean, parent_ids array<string>, modified_at timestamp, fetched_at timestamp, c string, x string, root string, top string"
T0 = datetime(2024, 1, 1)


def rows(spark, items):
    full = [(c, i, f, p, T0 + timedelta(days=d) if d is not None else None, T0, "c", "x", "r", "t") for c, i, f, p, d in items]
    return spark.createDataFrame(full, SCHEMA)


def walk(items):
    """Brute force over (connection, id, folder, parents), one row per item."""
    now = {(c, i): (f, p) for c, i, f, p, _ in items}
    up = {k: sorted({q for q in (p or []) if q and now.get((k[0], q), (False,))[0]}) for k, (f, p) in now.items()}
    out = []

    def ways(k, below):
        if not up[k]:
            yield [k[1]]
        for q in up[k]:
            if q not in below:
                for w in ways((k[0], q), below | {q}):
                    yield [*w, k[1]]

    for k in now:
        found = list(ways(k, {k[1]}))
        out += [(k[0], k[1], w[0], len(w) - 1, SEP.join(w)) for w in found]
        seen, todo = set(), list(up[k])
        while todo:
            q = todo.pop()
            if q not in seen:
                seen.add(q)
                todo += up[(k[0], q)]
        if k[1] in seen or not found:
            out.append((k[0], k[1], "", -1, ""))
    return sorted(out)


def result(df, **options):
    return sorted(tuple(r) for r in hierarchy(df, **options).select("c", "x", "root", "depth", "path").collect())


CASES = [
    ("a", "r", True, None, 0), ("a", "f", True, ["r"], 0), ("a", "g", True, ["f", "r"], 0), ("a", "h", False, ["g", None, "g"], 0),
    ("a", "l1", True, ["l3"], 0), ("a", "l2", True, ["l1"], 0), ("a", "l3", True, ["l2"], 0), ("a", "under", False, ["l2"], 0),
    ("a", "self", True, ["self"], 0), ("a", "s2", True, ["s2", "r"], 0), ("a", "m", True, ["r", "n"], 0), ("a", "n", True, ["m"], 0),
    ("a", "orphan", False, ["nobody"], 0), ("a", "infile", False, ["h"], 0), ("b", "r", True, [], 0), ("b", "x", False, ["f"], 0),
]


@pytest.mark.parametrize("block_rows", [1, 3, 50_000])
def test_against_walk(spark, block_rows):
    assert result(rows(spark, CASES), block_rows=block_rows) == walk(CASES)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    items = [(rng.choice("ab"), f"i{n}", rng.random() < 0.6, rng.sample([f"i{k}" for k in range(60)], rng.choice([0, 1, 1, 1, 2])), 0) for n in range(60)]
    assert result(rows(spark, items), block_rows=7) == walk(items)


def test_current_row_ties_and_nulls(spark):
    items = [("a", "r", True, None, 0), ("a", "x", False, ["r"], 2), ("a", "x", False, None, 1), ("a", "x", False, ["r"], 2), (None, "y", True, None, 0), ("a", None, True, None, 0), ("a", "z", None, ["r"], None)]
    assert result(rows(spark, items)) == [("a", "r", "r", 0, "r"), ("a", "x", "r", 1, f"r{SEP}x"), ("a", "z", "r", 1, f"r{SEP}z")]


def test_empty(spark):
    assert result(rows(spark, CASES).limit(0)) == []


def test_long_chain_over_many_blocks(spark):
    items = [("a", "i0", True, None, 0)] + [("a", f"i{n}", True, [f"i{n - 1}"], 0) for n in range(1, 200)]
    got = {r[1]: r[3] for r in result(rows(spark, items), block_rows=5)}
    assert got == {f"i{n}": n for n in range(200)}


def test_loop_over_blocks(spark):
    links = spark.createDataFrame([("a", f"i{n}", f"i{(n + 1) % 40}") for n in range(40)] + [("a", "t", "i3"), ("a", "u", "free")], "c string, x string, p string")
    got = {r.x: (r.top, r.loop) for r in chain_tops(links, block_rows=4, levels=2).collect()}
    assert all(loop for x, (_, loop) in got.items() if x != "u") and got["u"] == ("free", False)


def test_descendants(spark):
    got = {(r.x, r.below, r.distance) for r in descendants(hierarchy(rows(spark, CASES[:4]))).collect()}
    assert got == {("r", "f", 1), ("r", "g", 1), ("f", "g", 1), ("r", "h", 2), ("f", "h", 2), ("g", "h", 1)}


def test_forest():
    f = WeightedForest()
    f.link("b", "a", 1)
    f.link("c", "b", 1)
    f.link("a", "c", 1)
    assert f.find("c") == ("a", 2) and f.looped == {"a"}
