"""Training-data operators: brute force, exact round trips, held-out accuracy, edge cases."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.compare import check
from tidemark.llm import email_lines, lexicon, mixing, near_duplicates, neighbours, pii, queries, subjects, tokenizing

VOCABULARY = f"{tokenizing.TOKENIZERS}/byte_bpe_50k.tiktoken"


def test_catalogue(spark, data, duck):
    assert set(queries.ORACLES) <= set(queries.QUERIES)
    for name, sql in queries.ORACLES.items():
        check(queries.QUERIES[name](spark, data), duck, sql)


# --- encoding -----------------------------------------------------------------------------------
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokenizing.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_encoding_equals_the_library(spark):
    rng = random.Random(3)
    pool = [chr(c) for c in (*range(0, 700), 0x85, 0xA0, 0xB2, 0xBD, 0x1680, 0x2003, 0x2167, 0x3000, 0x4E00, 0xFEFF, 0x1F600)]
    texts = [None, "", " ", "a" * 20_000, "it's 12 <|endoftext|>\n\n  x", "word word word", "word word word"] + ["".join(rng.choices(pool, k=rng.randint(1, 50))) for _ in range(400)]
    # columns that clash with the operator's own names
    df = spark.createDataFrame([(i, t, "k", [1]) for i, t in enumerate(texts)], "doc_id long, text string, k string, ids array<int>")
    got = {r.doc_id: r.ids for r in tokenizing.encode(df, lexicon_words=50).collect()}
    reference = library()
    assert len(got) == len(texts) and all(got[i] == reference(t or "") for i, t in enumerate(texts))
    counts = {r.doc_id: r.n_tokens for r in tokenizing.token_counts(df, ["doc_id"]).collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    assert tokenizing.encode(df.limit(0)).count() == 0


def test_lexicon_ranks(tmp_path):
    ranks = lexicon.read_ranks(VOCABULARY)
    words = ["", " the", " then", "then", "é", " théâtre", "x"]
    (tmp_path / "l.npy").write_bytes(lexicon.compile_lexicon(words, ranks))
    lex = lexicon.Lexicon(str(tmp_path / "l.npy"))
    known = sorted(w.encode() for w in words if w)
    assert lex.rank([*known, b"", b" th", b"zz"]).tolist() == [*range(len(known)), -1, -1, -1]
    assert [lex.ids[lex.starts[i] : lex.starts[i + 1]].tolist() for i in range(len(known))] == [lexicon.merge(k, ranks) for k in known]


# --- mixing -------------------------------------------------------------------------------------
def test_mix(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(["word"] * rng.randint(20, 60)), "big" if i % 3 else "small") for i in range(300)] + [(900, None, "big"), (901, "", "small"), (902, "x", None), (None, "x", "big"), (1, "word", "big"), (903, "lone", "free")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("slot", F.lit(1)).withColumn("quota", F.lit(1)).withColumn("rank", F.lit("r"))
    t = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 4), ("none", 0.1, 2), (None, 0.1, 2), ("small", 0.0, 9)], "source string, target_share double, max_repeats int")
    mixed, report = mixing.mix(d, t, block_tokens=128, bucket_tokens=500)
    r = {x.source: x for x in report.collect()}
    assert set(r) == {"big", "small", "none"} and r["none"].mixed_tokens == 0
    assert r["big"].most_uses == 1 and r["small"].most_uses <= 4 and abs(r["small"].share / r["big"].share - 0.6) < 0.05
    rows = mixed.orderBy("slot").collect()
    assert len({(x.doc_id, x.copy) for x in rows}) == len(rows)
    half = [x.source for x in rows][: len(rows) // 2]
    assert abs(half.count("small") / len(half) - [x.source for x in rows].count("small") / len(rows)) < 0.1  # spread evenly
    assert mixing.mix(d.limit(0), t)[0].count() == 0


def test_quotas_fill_dry_sources(spark):
    supply = spark.createDataFrame([("a", 1, 100), ("b", 1, 1000), ("c", 1, 1000)], "source string, docs long, tokens long")
    t = spark.createDataFrame([("a", 0.5, 2), ("b", 0.25, 1), ("c", 0.25, 1)], "source string, target_share double, max_repeats int")
    assert {r.source: r.quota for r in mixing.quotas(supply, t, 1000).collect()} == {"a": 200, "b": 400, "c": 400}


def test_last_pass_skips_what_is_too_long(spark):
    rng, sizes = random.Random(4), {}
    for source, n in (("even", 40), ("long", 40), ("tiny", 3)):
        sizes[source] = [rng.choice((5, 9, 700 if source == "long" else 11)) for _ in range(n)]
    quota = {"even": 3 * sum(sizes["even"]) // 2, "long": 150, "tiny": 4}
    rows = []
    for source, own in sizes.items():
        before = 0
        for i, n in enumerate(own):
            full = min(2, quota[source] // sum(own))
            rows.append((source, len(rows), i, 0, n, before, quota[source], sum(own), 2, full))
            before += n
    docs = spark.createDataFrame(rows, "source string, doc_id long, h long, bucket long, n_tokens long, before long, quota long, whole long, max_repeats int, full long")
    got = {}
    for r in mixing.last_pass(docs).collect():
        got.setdefault(r.source, []).append((r.start, r.doc_id, r.n_tokens, r.copy))
    for source, own in sizes.items():
        taken = sorted(got.get(source, []))
        assert len({x[1] for x in taken}) == len(taken)
        open_ = quota[source] - taken[0][3] * sum(own)
        assert abs(open_ - sum(x[2] for x in taken)) <= 5  # the shortest text has five tokens
        assert all(a[0] + a[2] == b[0] for a, b in zip(taken, taken[1:]))  # no gaps
    assert sum(x[2] > 100 for x in got["long"]) == 0


# --- near duplicates ----------------------------------------------------------------------------
def edited(words, rng, share):
    return " ".join(rng.choice(("new", "other", str(rng.random()))) if rng.random() < share else w for w in words)


def jaccard_pairs(texts, k, least, min_words):
    sets = {}
    for i, t in texts:
        w = near_duplicates.WORD.findall((t or "").lower())
        if i is not None and len(w) >= min_words:
            sets.setdefault(i, []).append(set(zip(*(w[j:] for j in range(k)))))
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if any(len(x & y) >= least * len(x | y) for x in sets[a] for y in sets[b])}


@pytest.mark.parametrize(("k", "least", "group_rows"), [(3, 0.5, 32), (5, 0.8, 32), (3, 0.5, 2)])
def test_near_pairs(spark, k, least, group_rows):
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for f in range(12):
        base = rng.choices(vocabulary, k=rng.randint(40, 150))
        texts += [(f"d{f}-{n}", edited(base, rng, rng.choice((0, 0.02, 0.08)))) for n in range(5)]
    texts += [("n1", None), ("n2", ""), ("short", "a b c"), (None, texts[0][1]), ("copy", texts[0][1]), ("copy", texts[0][1]), ("LONG", " ".join(rng.choices(vocabulary, k=20_000)))]
    df = spark.createDataFrame(texts, "id string, text string").withColumn("k1", F.lit("x")).withColumn("sig", F.lit(1))
    got = {(r.a, r.b) for r in near_duplicates.near_pairs(df, "id", "text", min_words=30, shingle=k, threshold=least, group_rows=group_rows).collect()}
    want = jaccard_pairs(texts, k, least, 30)
    assert got <= want and len(got) >= 0.98 * len(want)
    classes = near_duplicates.near_classes(df, "id", "text", min_words=30, shingle=k, threshold=least)
    rows = {r.id: r for r in classes.collect()}
    assert rows["copy"].class_id == rows["d0-0"].class_id and rows["copy"].copies == 2 and "short" not in rows
    assert near_duplicates.near_pairs(df.limit(0), "id", "text").count() == 0


def test_frequent_segments_are_compared_in_blocks(spark):
    rng = random.Random(5)
    base = [f"v{i}" for i in range(60)]
    texts = [(f"d{n}", edited(base, rng, 0.03)) for n in range(60)]
    df = spark.createDataFrame(texts, "id string, text string")
    got = {(r.a, r.b) for r in near_duplicates.near_pairs(df, "id", "text", min_words=30, shingle=3, threshold=0.5, group_rows=4, rounds=1).collect()}
    want = jaccard_pairs(texts, 3, 0.5, 30)
    assert got <= want and len(got) >= 0.98 * len(want)


def test_large_families_keep_their_distant_pairs(spark):
    rng = random.Random(6)
    base = [f"v{i}" for i in range(45)]
    texts = [(f"d{n}", edited(base, rng, 0.08)) for n in range(300)]
    hot = [f"h{i} i{i} j{i} k{i}" for i in range(40)]  # short texts made of phrases that many use
    texts += [(f"s{n}", " ".join(rng.sample(hot, 9))) for n in range(300)]
    df = spark.createDataFrame(texts, "id string, text string")
    got = {(r.a, r.b) for r in near_duplicates.near_pairs(df, "id", "text", min_words=30, shingle=3, threshold=0.5, group_rows=32, rounds=3).collect()}
    want = jaccard_pairs(texts, 3, 0.5, 30)
    assert got <= want and len(got) >= 0.98 * len(want), (len(got), len(want))


def test_pairs_of_copies_have_a_hub(spark):
    text = " ".join(f"w{i}" for i in range(50))
    ids = [f"c{i:02}" for i in range(20)]
    rows = [(i, text) for i in ids] + [("x1", text + " more"), ("x2", text + " more")]
    df = spark.createDataFrame(rows, "id string, text string")
    got = {(r.a, r.b) for r in near_duplicates.near_pairs(df, "id", "text", hubs=3).collect()}
    every = {(a, b) for a, b in itertools.combinations([i for i, _ in rows], 2)}
    assert got == {(a, b) for a, b in every if {a, b} & {"c00", "c01", "c02", "x1", "x2"}}
    few = {(r.a, r.b) for r in near_duplicates.near_pairs(df, "id", "text", hubs=25).collect()}
    assert few == every


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_exact_pairs_and_groups(spark, monkeypatch, broadcast):
    monkeypatch.setattr(near_duplicates, "BROADCAST_ROWS", broadcast)
    rng = random.Random(8)
    hot = [f"h{i} i{i} j{i} k{i}" for i in range(20)]
    texts = [(f"s{n:03}", " ".join(rng.sample(hot, 9))) for n in range(120)]
    texts += [("copy", texts[0][1]), ("null", None), ("alone", " ".join(f"z{i}" for i in range(40)))]
    df = spark.createDataFrame(texts, "id string, text string")
    want = jaccard_pairs(texts, 3, 0.5, 30)
    got = near_duplicates.near_pairs(df, "id", "text", min_words=30, shingle=3, threshold=0.5, group_rows=4, exact=True)
    assert {(r.a, r.b) for r in got.collect()} == want
    group = {i: i for i, t in texts if t}  # smallest id that can be reached
    while moved := [(a, b) for a, b in want if group[a] != group[b]]:
        for a, b in moved:
            group[a] = group[b] = min(group[a], group[b])
    g = near_duplicates.near_groups(df, "id", "text", min_words=30, shingle=3, threshold=0.5, group_rows=4, exact=True).collect()
    assert {r.id: r.group_id for r in g} == group
    assert {r.id: r.copies for r in g}["copy"] == 2 and {r.id: r.class_id for r in g}["s000"] == "copy"


def test_empty_tables_have_no_groups(spark):
    empty = spark.createDataFrame([], "id string, text string")
    assert near_duplicates.near_groups(empty, "id", "text").collect() == [] and near_duplicates.near_pairs(empty, "id", "text").collect() == []


@pytest.mark.parametrize("most", [65_536, 16])
def test_pairs_of_frequent_shingles_are_whole(spark, monkeypatch, most):
    """No pair is lost, also where every shingle is frequent or has to be spread over blocks."""
    monkeypatch.setattr(near_duplicates, "GROUP_ROWS", most, raising=False)
    rng = random.Random(6)
    base = [f"v{i}" for i in range(45)]
    texts = [(f"d{n}", edited(base, rng, 0.1)) for n in range(150)]
    hot = [f"h{i} i{i} j{i} k{i}" for i in range(40)]
    texts += [(f"s{n}", " ".join(rng.sample(hot, rng.randint(8, 16)))) for n in range(300)]
    df = spark.createDataFrame(texts, "id string, text string")
    got = {(r.a, r.b) for r in near_duplicates.near_pairs(df, "id", "text", min_words=30, shingle=3, threshold=0.5).collect()}
    assert got == jaccard_pairs(texts, 3, 0.5, 30)


def test_only_near_pairs_are_written(spark, monkeypatch):
    """What large tables write grows with the near pairs, not with all pairs that share a shingle."""
    monkeypatch.setattr(near_duplicates, "BROADCAST_ROWS", 0)
    written, stage = {}, near_duplicates.stage

    def counted(df, label):
        out = stage(df, label)
        written[label] = written.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(near_duplicates, "stage", counted)
    rng = random.Random(9)
    hot = [" ".join(f"h{i}x{j}" for j in range(12)) for i in range(30)]
    texts = [(f"s{n}", " ".join([rng.choice(hot), *(f"o{n}x{j}" for j in range(30)), rng.choice(hot)])) for n in range(250)]
    df = spark.createDataFrame(texts, "id string, text string")
    got = {(r.a, r.b) for r in near_duplicates.near_pairs(df, "id", "text", min_words=30, shingle=3, threshold=0.5).collect()}
    assert got == jaccard_pairs(texts, 3, 0.5, 30) and written["met"] < 100


def test_pairs_come_once_and_without_a_shuffle(spark):
    base = " ".join(f"w{i}" for i in range(50))
    rows = [("a", base), ("a", base + " x"), ("b", base), ("b", base + " x"), ("c", base), ("c", base + " y"), ("d", base + " x"), ("e", base)]
    pairs = near_duplicates.near_pairs(spark.createDataFrame(rows, "id string, text string"), "id", "text", hubs=1)
    got = [(r.a, r.b) for r in pairs.collect()]
    assert len(got) == len(set(got)) and {("a", x) for x in "bcde"} <= set(got) and ("a", "a") not in got
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert not plan.startswith("Aggregate")  # all pairs of all copies were sorted out by one shuffle


def test_segments_frequent_in_a_batch_are_spread():
    doc, s, key = np.arange(10), np.array([7] * 8 + [8, 9], dtype=np.uint64), np.arange(100, 110)
    batch = near_duplicates._salted(doc, s, key, 4)
    rows = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
    assert sum(salt > 0 for _, _, salt in rows) == 8 and (int(near_duplicates.MARK), 7, 0) in rows
    ordered = sorted(rows + [(200, 7, 0), (201, 8, 0)], key=lambda r: (r[1], r[0]))
    met = [b.to_pylist() for b in near_duplicates._meet(4)([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*[(r[1], r[0], r[2]) for r in ordered])], ["sig", "k1", "salt"])])]
    met = [r for b in met for r in b]
    assert {(r["a"], r["b"]) for r in met if r["kind"] == 0} == {(108, 201)}
    assert sorted(r["a"] for r in met if r["kind"] == 1) == [*range(100, 108), 200]


def test_sketch_is_a_lower_bound():
    texts = ["a b c d e f g h i j k l", "a b c d e x g h i j k l m", "q w e r t y"]
    doc, h = near_duplicates.shingle_hashes(texts, 3)
    s = near_duplicates.parity_sketch(doc, h, 3, 4)
    sets = [set(h[doc == i].tolist()) for i in range(3)]
    for i, j in itertools.combinations(range(3), 2):
        assert np.bitwise_count(s[i] ^ s[j]).sum() <= len(sets[i] ^ sets[j])


# --- neighbours ---------------------------------------------------------------------------------
def test_neighbours(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(80, 16))
    v = np.concatenate([base + rng.normal(scale=s, size=base.shape) for s in (0, 0.1, 0.2, 0.3)])
    rows = [(f"v{i:03}", [float(x) for x in r]) for i, r in enumerate(v)]
    rows += [(f"same{i}", rows[0][1]) for i in range(9)]  # ties: more copies than neighbours asked for
    bad = [("x1", None), ("x2", [1.0] * 3), ("x3", [0.0] * 16), ("x4", [float("nan")] * 16), ("x5", [float("inf")] * 16), ("x6", [None] * 16), (None, rows[0][1]), ("v001", rows[1][1])]
    df = spark.createDataFrame(rows + bad, "id string, e array<float>").withColumn("key", F.lit(1)).withColumn("leaf", F.lit(1))
    unit = {i: np.asarray(e, dtype=np.float32).astype(float) for i, e in rows}
    unit = {i: e / np.linalg.norm(e) for i, e in unit.items()}
    want = set()
    for a in unit:
        near = sorted((-round(float(unit[a] @ unit[b]), 9), b) for b in unit if b != a)[:5]
        want |= {(min(a, b), max(a, b)) for c, b in near if -c >= 0.9}
    exact = {(r.a, r.b) for r in neighbours.nearest_pairs(df, "id", "e", dim=16, factor=1.0, shard_rows=16).collect()}
    assert exact == want
    local = {(r.a, r.b) for r in neighbours.nearest_pairs(df, "id", "e", dim=16, factor=1.0, shard_rows=10_000, local_rows=32).collect()}
    assert local == want
    relaxed = {(r.a, r.b) for r in neighbours.nearest_pairs(df, "id", "e", dim=16, factor=0.2, shard_rows=16).collect()}
    assert len(relaxed & want) >= 0.9 * len(want)
    assert neighbours.nearest_pairs(df.limit(0), "id", "e", dim=16).count() == 0


# --- mail lines ---------------------------------------------------------------------------------
@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Hi Ann,\n\nThe report is late.\n\nBest regards,\nBob Miller\nHead of Things\n+49 30 123456", [1, 3]),
        ("New text.\n\nOn 04.11.2024 20:22, Ann Lee <ann@x.example> wrote:\n> old\n> older\n\nAnswer below.", [1, 7]),
        ("New.\n\nAm 2024-07-17 20:21 schrieb ann@x.example:\n\nAlter Text ohne Zeichen.", [1]),
        ("New.\n\n-----Original Message-----\nFrom: A <a@x.example>\nSent: x\nSubject: y\n\nold", [1]),
        ("On 2024-11-23 16:39, Ann Lee\n<ann@x.example> wrote:\n> old one\nMy answer here.\n> old two", [4]),
        ("On Monday the desk wrote:\nall is fine here.", [1, 2]),
        ("Fine.\n> 40 units would be too many\nIndeed.", [1, 2, 3]),
        ("Regards to the whole team in the annex!", [1]),
        ("-- two dashes here on purpose\nmore text follows.", [1, 2]),
        ("Text.\n\n--\nBob", [1]),
        ("Tout est prêt.\n\nCordialement, Anne", [1]),
        ("Fine.\n\nBob Miller\nC/ Herreros 133, 6.º A, 99457 Valdeoro\n\n--- Passed on by the desk ---\nFrom: A\nTo: B\n\nold", [1]),
        ("Fine.\n--- Passed on by the desk ---\nreally.", [1, 2, 3]),
        (" \n\n", []),
        ("Hello Bob,", [1]),
    ],
)
def test_new_lines(text, want):
    assert email_lines.new_lines(text) == want


def mails(spark, rows):
    """Messages of (id, conversation, sender, number, text, addressees)."""
    df = spark.createDataFrame(rows, "message_id string, thread_id string, sender_header string, n int, text string, to_header string")
    return df.withColumn("sent_at", F.timestamp_seconds("n")).withColumn("fetched_at", F.col("sent_at")).withColumn("cc_header", F.lit(None).cast("string"))


def test_wordings_that_end_messages_are_learned(spark):
    note = "Zzz qqq this parcel of words is for its reader alone."
    rows = [(f"m{i}", f"t{i}", f"P{i} <p{i}@x.example>", i, f"Item number {i * 7} is on its way.\nAny thoughts on this?\nItem {i * 5} as well.\n\nFarewell from me, P{i}\nwrit by thumb\n\n{note}", None) for i in range(8)]
    rows.append(("odd", "t9", "Q <q@x.example>", 9, f"Item 900 too.\n\n{note[:-6]}alone. {note}", None))
    new = {(r.message_id, r.line_no) for r in email_lines.new_line_numbers(mails(spark, rows)).collect()}
    assert {x for x in new if x[0] == "m3"} == {("m3", 1), ("m3", 2), ("m3", 3)}
    assert {x for x in new if x[0] == "odd"} == {("odd", 1)}
    # without the method the same lines stay
    assert email_lines.new_lines(rows[3][4]) != [1, 2, 3]


def test_unmarked_quotations_of_other_conversations(spark):
    said, other = "The northern depot keeps its spare keys in the third drawer.", "Nobody counted the lamps of the southern hall this week."
    rows = [("a", "t1", "Ann <ann@x.example>", 1, said, "bob@x.example"), ("b", "t2", "Bob <bob@x.example>", 2, f"I looked again at the list.\n{said}", "Ann <ann@x.example>")]
    rows += [("c", "t3", "Eve <eve@x.example>", 3, other, "dan@x.example"), ("d", "t4", "Bob <bob@x.example>", 4, f"I looked for more.\n{other}", "Ann <ann@x.example>")]
    got = sorted((r.message_id, r.line_no) for r in email_lines.new_line_numbers(mails(spark, rows)).collect())
    assert got == [("a", 1), ("b", 1), ("c", 1), ("d", 1), ("d", 2)]  # c went to others: no inheritance


def test_the_method_decides(spark, data):
    """Without its evidence the form of the messages alone gives another result."""
    emails = spark.read.parquet(f"{data}/email_messages.parquet")
    got = {tuple(r) for r in email_lines.new_line_numbers(emails).collect()}
    form = {(r.message_id, i) for r in email_lines.current_messages(emails).collect() for i in email_lines.new_lines(r.text)}
    assert len(got ^ form) > 0.02 * len(form) and got


def test_inherited_sentences(spark):
    first = "The shipment of blue crates left the harbour on the second of May under number 4711."
    first = " ".join([first[:-1], *(f"and container{i} of yard{i * 7}" for i in range(60))]) + "."
    near = next(n for w in first.split() if (n := first.replace(w, w + "x", 1)) and bin(int(np.bitwise_xor(*email_lines.simhash([first, n]))) & (2**64 - 1)).count("1") <= 3)
    assert near != first
    rows = [("m1", "t", "A <a@x.example>", 1, first), ("m2", "t", "B <b@x.example>", 2, f"I agree with all of it.\n{near}"), ("m3", "u", "C <c@x.example>", 3, first), ("m4", None, None, None, None), ("m5", "t", None, 4, ""), (None, "t", None, 5, "lost"), ("m1", "t", "A <a@x.example>", 1, first), ("m6", "t", None, None, "x " * 50_000 + "end.")]
    df = spark.createDataFrame(rows, "message_id string, thread_id string, sender_header string, n int, text string").withColumn("sent_at", F.timestamp_seconds("n")).withColumn("fetched_at", F.col("sent_at")).withColumn("first", F.lit(0)).withColumn("h", F.lit("h"))
    got = sorted((r.message_id, r.line_no) for r in email_lines.new_line_numbers(df).collect())
    assert got == [("m1", 1), ("m2", 1), ("m3", 1), ("m6", 1)]
    assert email_lines.new_line_numbers(df.limit(0)).count() == 0


# --- personal information -----------------------------------------------------------------------
NAMES = pii.Names({"ann", "mark", "rose", "grace", "will", "may", "ume", "zoë"}, {"müller", "stone", "o'hara", "van den berg", "baker", "march"})


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Write to ann.m@x-y.example now", [("email", "ann.m@x-y.example")]),
        ("Send it to ann dot m at mail dot example today", [("email", "ann dot m at mail dot example")]),
        ("a.b [at] mail.example", [("email", "a.b [at] mail.example")]),
        ("tallow-kit@7.8.04 on 10.65.0.5", []),
        ("ring +49 30 23125 629 or (555) 555-0161 or +44 7700 900626 ext. 03", [("phone", "+49 30 23125 629"), ("phone", "(555) 555-0161"), ("phone", "+44 7700 900626 ext. 03")]),
        ("on +1555550168 487 of 813 and 00493023125989 12 more", [("phone", "+1555550168"), ("phone", "00493023125989")]),
        ("Order 4745 9840 3789, Invoice 587-95-5117-02 of 2024-07-19, Version 6.87.145.7714", []),
        ("lists passport no. L30519668, NI number QQ 05 23 55 B and SSN 917-06-0326.", [("id_number", "L30519668"), ("id_number", "QQ 05 23 55 B"), ("id_number", "917-06-0326")]),
        ("at 33 Harrow Lane, Flat 6, Thornby TS0 3QU, near", [("street_address", "33 Harrow Lane, Flat 6, Thornby TS0 3QU")]),
        ("in Lindenweg 98, 99582 Ahlbruck and 192 bis boulevard de la Garenne, 99537 Marvelle", [("street_address", "Lindenweg 98, 99582 Ahlbruck"), ("street_address", "192 bis boulevard de la Garenne, 99537 Marvelle")]),
        ("to C/ Herreros 133, 6.º A, 99457 Valdeoro first", [("street_address", "C/ Herreros 133, 6.º A, 99457 Valdeoro")]),
        ("Section 88 Road works and 70 street lamps", []),
        ("Ann Müller met Müller, Ann and ANN O'HARA's dog", [("person_name", "Ann Müller"), ("person_name", "Müller, Ann"), ("person_name", "ANN O'HARA")]),
        ("A. Müller and Rose van den Berg signed", [("person_name", "A. Müller"), ("person_name", "Rose van den Berg")]),
        ("Mark the row. Will it rain in March? May we go? Grace notes, rose petals and a stone wall.", []),
        ("Hi Rose,\nfine.\n- Mark", [("person_name", "Rose"), ("person_name", "Mark")]),
        ("Müller AG and Baker & Co", []),
        ("Ms Stone called", [("person_name", "Stone")]),
        ("", []),
    ],
)
def test_entities(text, want):
    assert [(k, text[a:b]) for k, a, b in pii.find_entities(text, NAMES)] == want


def test_replacement(spark):
    rows = [("text", "1", "Ann Müller <ann@x.example> called +49 30 23125 629."), ("text", "2", "ANN MÜLLER again; Müller, Ann too; ann at x dot example"), ("text", "3", "nothing"), ("text", "4", None), ("text", "1", "Ann Müller <ann@x.example> called +49 30 23125 629.")]
    df = spark.createDataFrame(rows, "field string, record_id string, text string").withColumn("places", F.lit(1)).where("text IS NOT NULL")
    got = {r.record_id: r.replaced for r in pii.replace(df, NAMES, b"k").collect()}
    assert set(got) == {"1", "2"}
    name = re.search(r"\[person_name: (\S+) (\S+)\]", got["1"])
    first, last = name.groups()
    assert f"[person_name: {first.upper()} {last.upper()}]" in got["2"] and f"[person_name: {last}, {first}]" in got["2"]
    assert re.search(r"\[phone: \+\d\d \d\d \d{5} \d{3}\]", got["1"]) and "Müller" not in got["1"] + got["2"]
    mail = re.search(r"<\[email: (\S+)\]>", got["1"]).group(1)
    assert mail.replace("@", " at ").replace(".", " dot ") in got["2"]
    many = spark.createDataFrame([("person_name", f"Ann{i}") for i in range(3000)], "kind string, value string")
    s = pii.assign_surrogates(many, b"k")
    assert s.count() == 3000 and s.select("surrogate").distinct().count() == 3000
    assert pii.detect(df.limit(0), NAMES).count() == 0


def test_name_lexicon(spark):
    people = spark.createDataFrame([("Müller, Ann", "ann.muller@x.example"), ("Bob van den Berg", None), (None, "x@x.example"), ("", None)], "display_name string, normalized_identifier string")
    mails = spark.createDataFrame([("Dr. Zoë Stone <zstone@x.example>",), ("Build Bot <printer@x.example>",), ("Eva Maier <emaier@x.example>",), (None,)], "sender_header string")
    got = {(r.part, r.name) for r in pii.name_lexicon(people, mails).collect()}
    assert got >= {("F", "ann"), ("L", "müller"), ("F", "bob"), ("L", "van den berg"), ("F", "eva"), ("L", "maier")} and ("L", "bot") not in got
    assert pii.name_lexicon(people.limit(0), mails.limit(0)).count() == 0


def test_names_stay_linked_by_their_parts(spark):
    lexicon = spark.createDataFrame([("F", "ann"), ("L", "müller"), ("L", "baker"), ("F", "uma"), ("L", "van den berg")], "part string, name string")
    people = ["Ann Müller", "Müller", "ANN", "Uma Baker", "Baker, Uma", "Uma", "Baker", "U. Baker", "V. Baker", "Ann van den Berg", "van den Berg", "Uma Müller"]
    found = spark.createDataFrame([("person_name", p) for p in people] + [("id_number", f"{i:03}") for i in range(400)], "kind string, value string")
    s = {(r.kind, r.entity): r.surrogate for r in pii.assign_surrogates(found, b"k", lexicon).collect()}
    name = {e: v for (k, e), v in s.items() if k == "person_name"}
    assert name["ann müller"] == f"{name['ann']} {name['müller']}" and name["uma baker"] == f"{name['uma']} {name['baker']}" and name["ann van den berg"] == f"{name['ann']} {name['van den berg']}"
    assert name["u. baker"] != name["v. baker"] and name["u. baker"].split()[1] == name["baker"]
    assert len(set(s.items())) == len({(k, v) for (k, _), v in s.items()}) == len(s)
    assert not {w.lower() for v in name.values() for w in v.split()} & {"ann", "uma", "müller", "baker"}


@pytest.mark.parametrize("address", ["12 rue du Lac, 75001 Paris", "59 old mill road", "12 LONG LANE, London, N1 7AA", "Alte Gasse 4b, 10115 Berlin"])
def test_addresses_keep_their_form_and_lose_their_words(address):
    new = pii.fit("street_address", address, pii.surrogate("street_address", pii.canonical("street_address", address), b"k"))
    kept = {w.lower() for w in re.findall(r"[^\W\d_]+", address)} & {w.lower() for w in re.findall(r"[^\W\d_]+", new)}
    assert kept <= {"rue", "road", "lane", "gasse"} and re.sub(r"\w+", "w", new) == re.sub(r"\w+", "w", address)
    assert all(o.isupper() == n.isupper() for o, n in zip(re.findall(r"[^\W\d_]{2,}", address), re.findall(r"[^\W\d_]{2,}", new)))


def test_a_large_lexicon_is_joined(spark):
    lexicon = spark.createDataFrame([("F", "ann"), ("L", "müller"), ("L", "van den berg"), ("F", "bob")], "part string, name string")
    rows = [("text", "1", "Ann Müller met Bob van den Berg."), ("text", "2", ""), ("sender_header", "3", "Müller, Ann <a@x.example>")]
    df = spark.createDataFrame(rows, "field string, record_id string, text string")
    assert pii.load_names(lexicon, bound=3) is None
    assert sorted(pii.detect(df, lexicon).collect()) == sorted(pii.detect(df, pii.load_names(lexicon)).collect())
    assert pii.detect(df, lexicon.limit(0)).where("kind = 'person_name'").count() == 0


# --- subjects -----------------------------------------------------------------------------------
def test_subjects(spark):
    rng = random.Random(4)
    words = {"art": [f"paint{chr(97 + i)}" for i in range(12)], "sea": [f"ship{chr(97 + i)}" for i in range(12)]}
    sentence = lambda s: " ".join(["the", "usual", *rng.choices(words[s], k=4)]) + "."
    docs, truth = [], {}
    for i in range(300):
        mine = rng.choice((("art",), ("sea",), ("art", "sea")))
        other = "sea" if mine[0] == "art" else "art"
        body = [sentence(s) for s in mine for _ in range(5)] + ([sentence(other)] if len(mine) == 1 and i % 5 == 0 else [])
        docs.append((i, " ".join(body)))
        truth[i] = set(mine)
    odd = [(900, None), (901, ""), (902, "  "), (None, "paint"), (903, "nothing known here"), (5, "x"), (904, " ".join([sentence("art")] * 20_000))]
    d = spark.createDataFrame(docs + odd, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("subject", F.lit("z"))
    labels = spark.createDataFrame([(i, s) for i in range(40) for s in truth[i]] + [(41, "sea"), (None, "art"), (2, None), (3, "unknown")], "doc_id long, subject string")
    areas = spark.createDataFrame([("art", "painting"), ("sea", None)], "subject string, description string")
    found = {}
    for r in subjects.document_subjects(d, labels, areas, common=0.9, modelled=0.9).collect():
        found.setdefault(r.doc_id, set()).add(r.subject)
    held = [i for i in range(50, 300)]
    assert sum(found.get(i, set()) == truth[i] for i in held) >= 0.95 * len(held)
    assert not set(found) & {900, 901, 902, 903, None} and found[904] == {"art"}
    assert subjects.document_subjects(d.limit(0), labels, areas).count() == 0
    assert subjects.document_subjects(d, labels.limit(0), areas.limit(0)).count() == 0


def test_documents_get_subjects_from_their_topics(spark):
    rng = random.Random(8)
    words = {"art": [f"paint{chr(97 + i)}" for i in range(12)], "sea": [f"ship{chr(97 + i)}" for i in range(12)]}
    docs = [(i, " ".join(" ".join(rng.choices(words[s], k=6)) + "." for _ in range(6))) for i, s in enumerate(("art", "sea") * 100)]
    # two short sentences with one term of the other subject: a vote each, but hardly any of the topics
    docs += [(900 + i, " ".join([" ".join(rng.choices(words["art"], k=40)) + "." for _ in range(6)] + ["shipa."] * 2)) for i in range(20)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, ("art", "sea")[i % 2]) for i in range(40)], "doc_id long, subject string")
    areas = spark.createDataFrame([("art", None), ("sea", None)], "subject string, description string")
    found = {}
    for r in subjects.document_subjects(d, labels, areas, common=0.9, modelled=0.9).collect():
        found.setdefault(r.doc_id, set()).add(r.subject)
    assert all(found[900 + i] == {"art"} for i in range(20))


def test_topics_decide_the_subjects(spark, data, monkeypatch):
    """With flat topics in place of the fitted ones hardly a subject is left."""
    d, labels, areas = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "subject_labels", "subjects"))
    got = {tuple(r) for r in subjects.document_subjects(d, labels, areas).collect()}
    monkeypatch.setattr(subjects, "topic_model", lambda docs, start, prior, used, alpha, passes: np.ones_like(start))
    flat = {tuple(r) for r in subjects.document_subjects(d, labels, areas).collect()}
    assert got and len(got & flat) < 0.5 * len(got)


def test_topics_have_settled(spark, data, monkeypatch):
    """One more pass over all documents hardly moves the topics any further."""
    fit, seen = subjects.topic_model, []
    monkeypatch.setattr(subjects, "topic_model", lambda *a: seen.append((a, fit(*a))) or seen[-1][1])
    d, labels, areas = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "subject_labels", "subjects"))
    assert subjects.document_subjects(d, labels, areas).count() > 0
    (docs, _, *rest, _), topics = seen[0]
    again = fit(docs, topics, *rest, 1)
    assert 0.5 * np.abs(again / again.sum(0) - topics / topics.sum(0)).sum(0).max() < 0.02


def test_settled_topics_keep_the_words_of_rare_languages(spark):
    """Labels are given in the frequent language mostly; the rare one has wordings of its own in every document."""
    rng = random.Random(6)
    areas, docs, truth = ["art", "law", "sea", "tax"], [], {}
    words = {(s, lang): [f"{s}{lang}{chr(97 + i)}" for i in range(20)] for s in areas for lang in ("en", "xx")}
    usual = {lang: [f"usual{lang}{chr(97 + i)}" for i in range(30)] for lang in ("en", "xx")}
    for i in range(600):
        lang, mine = "xx" if i % 6 == 0 else "en", rng.choice(areas)
        sentences = [rng.choices(words[mine, lang], k=3) + rng.choices(usual[lang], k=3) for _ in range(4)] + [rng.choices(usual[lang], k=6) for _ in range(6)]
        docs.append((i, ". ".join(map(" ".join, sentences)), lang if i % 50 else None))
        truth[i] = {mine}
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, s) for i in range(120) for s in truth[i]], "doc_id long, subject string")
    found = {}
    for r in subjects.document_subjects(d, labels, spark.createDataFrame([(s, None) for s in areas], "subject string, description string"), common=0.9, modelled=0.9).collect():
        found.setdefault(r.doc_id, set()).add(r.subject)
    rare = [i for i in range(120, 600) if i % 6 == 0]
    assert sum(found.get(i, set()) == truth[i] for i in rare) >= 0.95 * len(rare)
    assert sum(found.get(i, set()) == truth[i] for i in range(120, 600)) >= 0.95 * 480


def test_vocabularies_of_languages():
    langs = ["en"] * 60 + ["de"] * 30 + [None] * 5 + ["fr"] + ["es"] * 4
    words = subjects.vocabularies(langs, np.arange(100) != 99)
    assert len(set(words[:60])) == 1 and len(set(words[60:90])) == 1 and words[0] != words[60]
    assert set(words[90:96]) == {words[0]} and words[96] == words[98] != words[0] and words[99] == -1
    assert set(subjects.vocabularies([None] * 3, np.array([True, True, False]))) == {0, -1}
    p = subjects._expected(np.full((100, 2), 50.0), words)  # shares of its own in every language
    assert np.allclose([p[words == w].sum(0) for w in set(words[:99])], 1, atol=0.02)


def test_topics_settle_in_few_passes(spark, monkeypatch):
    rng, pick = random.Random(3), np.random.default_rng(3)
    words = {s: ["".join(rng.choices("abcdefgh", k=5)) for _ in range(60)] for s in ("art", "sea", "law")}
    docs = [(i, " ".join(rng.choices([w for s in words.values() for w in s], k=40) + rng.choices(words[("art", "sea", "law")[i % 3]], k=8)), int(pick.integers(3))) for i in range(600)]
    moved, n = subjects.moved, []
    monkeypatch.setattr(subjects, "moved", lambda *a: n.append(moved(*a)) or n[-1])
    d = spark.createDataFrame(docs, "doc_id long, text string, n long")
    labels = spark.createDataFrame([(i, ("art", "sea", "law")[i % 3]) for i in range(60)], "doc_id long, subject string")
    areas = spark.createDataFrame([(s, None) for s in words], "subject string, description string")
    subjects.document_subjects(d, labels, areas, common=0.9, modelled=0.9).collect()
    assert n[-1] <= subjects.SETTLED
    assert len(n) <= 7  # 10 when every pass began where the last one ended


def test_spelled_words_and_sentences():
    odd = ['Ab c. "Def’s ghi!" x_yz 12ab½ É²t\n\nΣΑΣ٣kl—mn', "", "S D\x01 end.", "a@b.com says: 'stop.'), go on?\tYes..  no\n. D"]
    odd += ["".join(random.Random(i).choices("abcDéßİ½²٣’— _1.!?\"')»,;\n\t", k=60)) for i in range(300)]
    odd += [" ".join(f"abc{chr(0x2600 + i)}def" for i in range(80))]  # many kinds of what parts words
    end = re.compile(r"(?<=[.!?])[\"'”»)\]]*[,;]?\s+|\n+")
    plain = [[subjects.WORD.findall(s) for s in end.split(subjects._plain(t))] for t in odd]
    texts = " ".join(t.decode() for t in subjects._spelled(odd, sentences=True)).split("D")
    assert len(texts) == len(odd)
    got = [[[w for w in s.split() if len(w) > 2] for s in t.split("S")] for t in texts]
    assert [[s for s in t if s] for t in got] == [[s for s in t if s] for t in plain]


def test_inference_keeps_the_count_of_terms():
    rng = np.random.default_rng(3)
    expected = subjects._expected(rng.gamma(1.0, 1.0, (30, 4)))
    ids, doc = rng.integers(0, 30, 200), np.sort(rng.integers(0, 5, 200))
    gamma, d, term, took = subjects.infer(ids, doc, 6, expected, 0.05)
    weight = 1 + np.log(np.unique(doc << 32 | ids, return_counts=True)[1])
    assert np.allclose(took.sum(1), weight, rtol=1e-4) and np.allclose((gamma - 0.05).sum(1), np.bincount(d, weights=weight, minlength=6), atol=1e-2)
    assert abs(subjects._digamma(np.array([1.0]))[0] + 0.5772156649) < 1e-7
