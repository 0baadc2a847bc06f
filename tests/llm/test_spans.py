import random
from collections import defaultdict

from ledgerloom.llm import spans as sp


def brute(rows, least):
    own = defaultdict(set)
    for s, r, t in rows:
        for i in range(len(t or "") - least + 1):
            own[t[i : i + least]].add((s, r))
    out = set()
    for s, r, t in rows:
        spans = []
        for i in range(len(t or "") - least + 1):
            if len(own[t[i : i + least]]) > 1:
                if spans and i + least == spans[-1][1] + 1:
                    spans[-1][1] += 1
                else:
                    spans.append([i, i + least])
        out |= {(s, r, a, b) for a, b in spans}
    return out


def sample(least):
    r = random.Random(5)
    text = lambda n: "".join(r.choice("abcdé नक😀 ") for _ in range(n))
    shared = [text(n) for n in (least - 1, least, least + 1, 3 * least)]
    rows = []
    for k in range(60):
        parts = [text(r.randrange(40)), r.choice(shared), text(r.randrange(40))] + ([r.choice(shared)] if k % 3 == 0 else [])
        rows.append((r.choice("xy"), str(k), "".join(parts)))
    rows += [("x", "same", shared[3]), ("y", "same", shared[3]), ("x", "alone", text(90) * 4), ("x", "null", None), ("x", "empty", "")]
    big = text(3000)
    rows += [("x", "big1", text(50) + big), ("y", "big2", big + text(50)), ("z", "tile", "ab" * 400), ("z", "tile2", "ab" * 200 + "c")]
    return rows


def test_against_brute_force(spark):
    least = 50
    rows = sample(least)
    df = spark.createDataFrame([(*x, 0, "q") for x in rows + rows[:9]], "source_table string, record_id string, text string, rec int, h string")
    want = brute(rows, least)
    got = {tuple(r) for r in sp.shared_spans(df, least, 30).collect()}
    assert got == want
    assert {tuple(r) for r in sp.sharing_records(df, least, 30).collect()} == {x[:2] for x in want}
    report = {(r.source_table, r.record_id): r for r in sp.sharing_report(df, least, 30).collect()}
    assert len(report) == len({x[:2] for x in rows})
    for s, k, t in rows:
        covered = len({i for x, y, a, b in want if (x, y) == (s, k) for i in range(a, b)})
        assert report[s, k].chars == len(t or "") and report[s, k].shared_chars == covered


def test_hot_passage_and_empty(spark):
    r = random.Random(1)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = text(210)
    rows = [("t", str(i), text(60) + passage + text(60)) for i in range(400)] + [("t", f"o{i}", text(300)) for i in range(50)]
    df = spark.createDataFrame(rows, "source_table string, record_id string, text string")
    assert {x.record_id for x in sp.sharing_records(df).collect()} == {str(i) for i in range(400)}
    none = spark.createDataFrame([], "source_table string, record_id string, text string")
    assert sp.sharing_records(none).count() == sp.shared_spans(none).count() == sp.sharing_report(none).count() == 0


def test_factors_agree_with_their_sources(spark):
    least = 50
    rows = sample(least)
    texts = {x[:2]: x[2] for x in rows}
    df = spark.createDataFrame(rows, "source_table string, record_id string, text string")
    got = sp.shared_factors(df, least, 30).collect()
    for f in got:
        a, b = texts[f.source_table, f.record_id], texts[f.from_table, f.from_id]
        assert (f.source_table, f.record_id) != (f.from_table, f.from_id) and f.factor_end - f.factor_start >= least
        assert a[f.factor_start : f.factor_end] == b[f.from_start : f.from_start + f.factor_end - f.factor_start]
    assert {(f.source_table, f.record_id) for f in got} == {x[:2] for x in brute(rows, least)}


def test_equal_hashes_of_different_windows(spark, monkeypatch):
    """With hashes that say nothing the first parse is refused, and the next gives the right records."""
    spans = sp._Hasher.spans
    monkeypatch.setattr(sp._Hasher, "spans", lambda self, n, at=None: spans(self, n, at) if self.base != sp._Hasher(0).base or at is None else spans(self, n, at) * 0)
    rows = [("x", str(k), t) for k, t in enumerate(["ab" * 200 + "c", "ab" * 150 + "d", "d" + "ab" * 120, "xyz" * 90])]
    passed = []
    checked = sp._checked
    monkeypatch.setattr(sp, "_checked", lambda *a: passed.append(1) or checked(*a))
    got = {r.record_id for r in sp.sharing_records(spark.createDataFrame(rows, "source_table string, record_id string, text string")).collect()}
    assert got == {"0", "1", "2"} and passed


def test_a_hot_passage_sends_few_rows_under_one_key(spark):
    r = random.Random(4)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = text(400)
    rows = [(i, (passage if i % 2 else text(40)) + text(300)) for i in range(4000)]
    texts = spark.createDataFrame(rows, "rec bigint, text string").repartition(4).cache()
    anchors = sp._filter(sp._shared_anchors(texts, sp.LEAST, sp.GRAM, 0))
    for which, most in ((sp._ALL, 2), (sp._FIRST, 1), (sp._REST, 1)):
        keys = sp._parsed(texts, anchors, sp.LEAST, sp.GRAM, 0, which).where("h is not null").groupBy("h").count().agg({"count": "max"}).first()[0]
        assert keys <= 4 * most


def test_found(spark, sf):
    from ledgerloom.llm.queries import _passages, p6_found

    rows = [tuple(r) for r in _passages(spark, sf).distinct().collect()]
    assert {tuple(r) for r in p6_found(spark, sf).collect()} == {x[:2] for x in brute(rows, sp.LEAST)}
