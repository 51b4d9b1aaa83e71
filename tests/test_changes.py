"""Change feeds: order, retractions, batches, edge cases."""

import random
from datetime import datetime, timedelta

import pytest

from tidemark.operators.changes import ChangeTable, apply_feed

DOC = "struct<external_id: string, source_type: string, title: string, content: string, label_ids: array<string>, created_at: timestamp>"
SCHEMA = f"delivery_id long, connection_id string, history_id string, page_no int, documents array<{DOC}>, deleted_external_ids array<string>, next_page_token string, received_at timestamp, file string, row long, dead boolean"
T0 = datetime(2024, 1, 1)


def frame(spark, pages):
    """Pages as (delivery, connection, history, page, upserts, deletes, hour)."""
    return spark.createDataFrame([(d, c, h, p, None if u is None else [None if x is None else (x, "email", "t", f"{d}", None, None) for x in u], g, None, None if at is None else T0 + timedelta(hours=at), "f", 1, True) for d, c, h, p, u, g, at in pages], SCHEMA)


def brute(pages):
    last = {}
    for d, c, h, p, u, g, at in pages:
        try:
            key = (c, int(h), p or 0)
        except (TypeError, ValueError):
            continue
        if c is not None and (key not in last or ((at is not None, at or 0), d) > last[key][0]):
            last[key] = (((at is not None, at or 0), d), h, u, g)
    state = {}
    for (c, _, _), (_, h, u, g) in sorted(last.items(), key=lambda x: x[0]):
        for x in u or []:
            if x is not None:
                state[(c, x)] = h
        for m in g or []:
            if m is not None:
                for k in [k for k in state if k[0] == c and (k[1] == m or k[1].split(":attachment:")[0] == m)]:
                    del state[k]
    return sorted((c, x, h) for (c, x), h in state.items())


def shown(df):
    return sorted((r.connection_id, r.external_id, r.history_id) for r in df.collect())


CASES = [
    (1, "a", "10", 0, ["m1", "m1:attachment:1", "m2"], None, 1), (2, "a", "9", 0, ["m1"], ["m2"], 2), (3, "a", "11", 1, ["m2", "m2"], ["m1"], 3), (4, "a", "11", 0, ["m1"], [], 4),
    (5, "a", "11", 0, ["m3"], None, 5), (6, "a", None, 0, ["zz"], None, 6), (7, "a", "", 0, ["zz"], None, 6), (8, "a", "word", 0, ["zz"], None, 6), (9, None, "3", 0, ["zz"], None, 6),
    (10, "b", "10", 0, ["m1", None], ["nobody", None], 1), (11, "b", "12", None, ["m9:attachment:2"], ["m9:attachment:1"], None), (11, "b", "12", None, ["m9:attachment:2"], ["m9:attachment:1"], None),
    (12, "a", "12", 0, None, None, 7), (13, "a", "13", 0, ["m4"], ["m4"], 8), (14, "a", "14", 0, ["m4"], None, 8),
]


def test_rules(spark):
    assert shown(apply_feed(frame(spark, CASES))) == brute(CASES)


def test_empty(spark):
    assert shown(apply_feed(frame(spark, CASES).limit(0))) == []


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_batches_in_any_order_give_one_state(spark, seed):
    rng = random.Random(seed)
    names = ["m1", "m2", "m1:attachment:1", "m2:attachment:1", "m3"]
    pages = [(n, rng.choice("ab"), str(rng.randint(1, 6)), rng.randint(0, 1), rng.sample(names, rng.randint(0, 3)), rng.sample(["m1", "m2", "m3"], rng.randint(0, 1)), rng.randint(0, 9)) for n in range(24)]
    changes = ChangeTable(spark, files=3)
    for at in range(0, 24, 8):
        changes.apply(frame(spark, pages[at : at + 8]))
        assert shown(changes.read()) == brute(pages[: at + 8])
    before = shown(changes.read())
    changes.apply(frame(spark, pages[:8]))  # a batch delivered again changes nothing
    assert shown(changes.read()) == before


def test_vectors_not_files_change(spark):
    changes = ChangeTable(spark)
    changes.apply(frame(spark, CASES[:1]))
    n = changes._read("images").count()
    changes.apply(frame(spark, CASES[1:3]))
    assert changes._read("images").count() == n + 3  # images are only appended
