import random
import re
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import neardup as nd
from ledgerloom.llm.bagminhash import mix, signatures


@pytest.mark.parametrize("wa, wb", [((1, 1), (1, 1)), ((3, 1), (1, 2)), ((0.4, 1), (1, 0.3)), ((9, 2.5), (5, 2.5))])
def test_registers_are_unbiased(wa, wb):
    e = mix(np.arange(40, dtype=np.uint64))
    a, b = (np.where(np.arange(40) < 20, *w).astype(float) for w in (wa, wb))
    a[5:8], b[30:36] = 0, 0
    s = signatures(np.r_[np.zeros(40, int), np.ones(40, int)], np.r_[e, e], np.r_[a, b], 2, 20_000)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((s[0] == s[1]).mean() - want) < 4 * (want * (1 - want) / 20_000) ** 0.5 + 1e-9
    assert np.isinf(signatures(np.array([], int), np.array([], np.uint64), np.array([]), 1, 8)).all()


def brute(rows, like):
    bags = {}
    for i, t in rows:
        w = re.findall("[a-z0-9]+", (t or "").lower())
        c = Counter(tuple(w[k : k + like.run]) for k in range(len(w) - like.run + 1))
        if c and i is not None:
            bags[i] = c if like.multiset else Counter(set(c))
    ids = sorted(bags)
    sim = lambda a, b: (a & b).total() / (a | b).total()
    return {(i, j) for n, i in enumerate(ids) for j in ids[n + 1 :] if sim(bags[i], bags[j]) >= like.threshold}


def sample(r, n):
    words = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(n):
        base = r.choices(words, k=40)
        rows.append((f"b{k}", " ".join(base)))
        for v in range(r.randrange(4)):
            t = list(base)
            for _ in range(r.randrange(6)):
                t[r.randrange(len(t))] = r.choice(words)
            rows.append((f"b{k}v{v}", ", ".join(t).upper()))
    return rows


@pytest.mark.parametrize("like", [nd.CLAUSE_TEXT, nd.TITLE, nd.SHINGLES, nd.Likeness(2, 0.7, 5, 60, multiset=True)])
def test_pairs(spark, like):
    rows = sample(random.Random(3), 40) + [("n", None), ("e", ""), ("s", "w1"), ("d", "w1 w1 w2 w2"), (None, "w1 w2 w3 w4 w5"), ("long", "w7 " * 50_000)]
    df = spark.createDataFrame([(*x, 1, "y") for x in rows + rows[:20]], "id string, text string, cls int, band string")
    got = {tuple(r) for r in nd.pairs(df, like).collect()}
    want = brute(rows, like)
    assert got <= want and len(want - got) <= 0.01 * len(want)


def test_large_classes_and_groups(spark):
    text = "the claim for room rent is assessed on a pro rata basis and paid promptly after review by the insurer in writing"
    copies = [(f"c{k:03}", text) for k in range(nd.EXPAND + 36)]
    near = [("near", text + " today"), ("far", "nothing in common with any other of these texts at all")]
    df = spark.createDataFrame(copies + near, "id string, text string")
    got = {tuple(r) for r in nd.pairs(df, nd.CLAUSE_TEXT).collect()}
    assert got == {("c000", i) for i, _ in copies[1:]} | {("c000", "near")}
    groups = {r.id: (r.group_id, r.links) for r in nd.groups(df, nd.CLAUSE_TEXT).collect()}
    assert groups == {i: ("c000", 1) for i, _ in copies} | {"near": ("c000", 1), "far": ("far", 0)}


@pytest.mark.parametrize("like", [nd.CLAUSE_TEXT, nd.Likeness(2, 0.7, 5, 60, multiset=True)])
def test_crowded_buckets(spark, monkeypatch, like):
    """With every bucket too full, the exact way alone finds all pairs."""
    monkeypatch.setattr(nd, "CROWD", 0)
    monkeypatch.setattr(nd, "BLOCK", 3)
    rows = sample(random.Random(8), 30) + [("n", None), ("e", ""), ("s", "w1 w2 w3"), ("d", "w1 w2 w3 w1 w2 w3 w1")]
    got = {tuple(r) for r in nd.pairs(spark.createDataFrame(rows, "id string, text string"), like).collect()}
    assert got == brute(rows, like)


@pytest.mark.parametrize("crowd, in_task", [(3, 10**9), (3, 5), (10**6, 0)])
def test_buckets_of_any_size(spark, monkeypatch, crowd, in_task):
    """Crowded buckets, in one task or altogether, lose no pair, whatever the batches."""
    monkeypatch.setattr(nd, "CROWD", crowd)
    monkeypatch.setattr(nd, "HOT_IN_TASK", in_task)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = sample(random.Random(9), 30)
        got = {tuple(r) for r in nd.all_pairs(spark.createDataFrame(rows, "id string, text string"), nd.CLAUSE_TEXT).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = brute(rows, nd.CLAUSE_TEXT)
    assert got <= want and len(want - got) <= 0.01 * len(want)


def test_exact_way_for_all(spark):
    rows = sample(random.Random(10), 40)
    got = {tuple(r) for r in nd.all_pairs(spark.createDataFrame(rows, "id string, text string"), nd.TITLE, exact=True).collect()}
    assert got == brute(rows, nd.TITLE)


def test_two_texts_of_one_id(spark):
    a = "the claim for room rent is assessed on a pro rata basis and paid promptly after review by the insurer"
    b = "bills of the hospital are kept by the nominee until the policy year in which they fell due has ended"
    rows = [("a", a), ("a", b), ("x", a + " today"), ("y", b + " today"), ("z", "nothing alike")]
    got = {tuple(r) for r in nd.all_pairs(spark.createDataFrame(rows, "id string, text string"), nd.CLAUSE_TEXT).collect()}
    assert got == {("a", "x"), ("a", "y")}


def test_empty(spark):
    df = spark.createDataFrame([], "id string, text string")
    assert nd.pairs(df, nd.TITLE).count() == nd.groups(df, nd.TITLE).count() == 0


def test_found(spark, sf):
    from ledgerloom.llm.queries import p4_found

    got = {tuple(r) for r in p4_found(spark, sf).collect()}
    read = lambda t, a, b: [tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(a, b).distinct().collect()]
    want = {("clause_text", *p) for p in brute(read("policy_clause", "clause_id", "original_text"), nd.CLAUSE_TEXT)} | {("title", *p) for p in brute(read("corpus_document", "corpus_document_id", "title"), nd.TITLE)}
    assert got <= want and len(want - got) <= 0.02 * len(want)


def test_all_pairs_of_large_classes(spark, monkeypatch):
    """Titles of one set of words are alike, whatever their order and case, and so are all records like them."""
    monkeypatch.setattr(nd, "BLOCK", 20)
    words = "alpha beta gamma delta epsilon zeta eta".split()
    r = random.Random(2)
    rows = [(f"t{k:03}", " ".join(r.sample(words, 7)).title()) for k in range(nd.EXPAND + 20)] + [(f"u{k}", " ".join(words + ["theta"])) for k in range(30)] + [("v", "other words"), ("w", None)]
    got = [tuple(x) for x in nd.all_pairs(spark.createDataFrame(rows, "id string, text string"), nd.TITLE).collect()]
    assert set(got) == brute(rows, nd.TITLE) and len(got) == len(set(got)) == 114 * 113 // 2


def test_disk_is_freed(spark):
    """What was read for the last time is deleted: the shuffle files of the steps as soon as their tables are there, and all tables but those that the result reads."""
    from ledgerloom import session

    kept = list(session._WRITTEN)
    found = nd.all_pairs(spark.createDataFrame(sample(random.Random(11), 30), "id string, text string"), nd.CLAUSE_TEXT)
    left = {x.rpartition("/")[2].rpartition("-")[0] for x in session._WRITTEN if x not in kept}
    assert left == {"alike", "members", "sizes", "across", "dealt", "hot"} and found.count() > 20

    def shuffles():
        return {x for x in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split() if "shuffle_" in x}

    before = shuffles()
    table = session.cut(spark.range(1000).repartition(3, "id"), "freed", free=True)
    after = shuffles()
    assert after <= before and table.count() == 1000 and spark.conf.get(session._FREE, None) is None
    session.discard(table)
    with pytest.raises(ValueError):
        session.discard(spark.range(3))


def test_meet_of_sorted_batches(spark, monkeypatch):
    """Buckets that go on over batches, with classes in any order, repeated, crowded, marked before, between or behind."""
    monkeypatch.setattr(nd, "CROWD", 4)
    r, rows = random.Random(12), []
    for band in range(60):
        classes = r.choices(range(1000), k=r.choice([1, 2, 3, 4, 5, 9]))
        rows += [(band, c) for c in classes + classes[:2]] + [(band, None)] * (band % 7 == 0)
    r.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = [tuple(x) for x in nd._meet(spark.createDataFrame(rows, "band bigint, cls bigint")).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pairs, alone = set(), set()
    for band in range(60):
        of = {c for b, c in rows if b == band and c is not None}
        if len(of) > 4 or (band, None) in rows:
            alone |= of
        else:
            pairs |= {(a, b) for a in of for b in of if a < b}
    assert {x for x in got if x[1] is not None} == pairs and {a for a, b in got if b is None} == alone
