import datetime as dt

from pyspark.sql import functions as F

from ledgerloom.operators.components import components
from ledgerloom.operators.orphan_refs import orphans, plain_key
from ledgerloom.operators.predicates import compile_predicate, facts_of
from ledgerloom.operators.records import agreement, align_lines, apportion, decode_cursor, encode_cursor, index_quantiles, latest
from ledgerloom.operators.skew import salted_join
from ledgerloom.operators.snapshot_diff import consecutive, diff, diff_builds
from ledgerloom.sources.snapshots import SnapshotStore

T = dt.datetime
BUILD = "build_id bigint, source_root string, created_on date, delivered_at timestamp_ntz, documents array<struct<corpus_document_id:string,document_hash:string,clause_set_hash:string,artifact_bytes:bigint>>, document_hashes map<string,string>, change string"


def test_diff_builds(spark):
    d1, d2 = dt.date(2024, 1, 1), dt.date(2024, 2, 1)
    rows = [
        (1, "r", d1, T(2024, 1, 1), [("a", "sha256:AA", None, 1), ("b", None, "x", 1), (None, "q", "q", 1)], {"c": "cc"}, "x"),
        (1, "r", d1, T(2024, 1, 1), [("a", "sha256:AA", None, 1), ("b", None, "x", 1), (None, "q", "q", 1)], {"c": "cc"}, "x"),
        (2, "r", d2, T(2024, 2, 1), [("a", "zz", "k", 1)], None, None),
        (3, "r", d2, T(2024, 2, 2), [("a", "aa", "k", 1), ("a", "aa", "k", 1), ("b", "new", "Y", 1)], {"d": None}, None),
        (4, None, d2, T(2024, 2, 2), None, None, None),
        (5, "s", d1, T(2024, 1, 1), None, None, None),
        (6, "s", d2, None, [("a", None, None, 1)], None, None),
    ]
    got = {tuple(r) for r in diff_builds(spark.createDataFrame(rows, BUILD)).collect()}
    assert got == {(1, 3, "b", "changed"), (1, 3, "c", "removed"), (1, 3, "d", "added"), (5, 6, "a", "added")}
    assert diff_builds(spark.createDataFrame([], BUILD)).count() == 0


def test_orphans(spark):
    ref = "source_table string, record_id string, ref_key string, kind string, at timestamp_ntz, month int"
    par = "kind string, key string, arrived_at timestamp_ntz, deleted_at timestamp_ntz"
    t = T(2024, 5, 10)
    refs = [("t", "1", " A ", "k", t, 0), ("t", "1", " A ", "k", t, 0), ("t", "2", "b", "k", t, 0), ("t", "3", "c", "k", t, 0), ("t", "4", "d", "k", t, 0), ("t", "5", None, "k", t, 0), ("t", "6", "  ", "k", t, 0), ("t", "7", "nope", "k", None, 0), ("t", "8", "b", "k", None, 0), ("t", "9", "always", "k", t, 0), ("t", "10", "A", "other", t, 0), ("t", "11", "b", "k", T(2024, 5, 9), 0)]
    refs += [("t", f"h{i}", "hot", "k", t, 0) for i in range(3000)]
    parents = [("k", "a", T(2020, 1, 1), None), ("k", "a", T(2020, 1, 1), None), ("k", "b", T(2020, 1, 1), T(2024, 5, 10)), ("k", "c", T(2024, 5, 11), None), ("k", "d", T(2024, 5, 10), T(2024, 5, 11)), ("k", "always", None, None), ("k", None, None, None)]
    df = spark.createDataFrame(refs, ref).withColumn("key", plain_key(F.col("ref_key")))
    got = {(r.record_id, r.reason) for r in orphans(df, spark.createDataFrame(parents, par)).collect()}
    assert got == {("2", "deleted"), ("3", "late"), ("7", "missing"), ("10", "missing")} | {(f"h{i}", "missing") for i in range(3000)}
    assert orphans(df.limit(0), spark.createDataFrame([], par)).count() == 0


def test_salted_join(spark):
    big = spark.createDataFrame([("h", i) for i in range(5000)] + [("c", 1), (None, 2)], "k string, v int")
    small = spark.createDataFrame([("h", "x"), ("h", "y"), ("c", "z"), (None, "n")], "k string, w string")
    got = salted_join(big, small, "k")
    assert got.count() == 10_001 and got.columns == ["k", "v", "w"]


def test_components(spark):
    e = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (5, 5), (None, 1), (200, 100)] + [(300, i) for i in range(301, 340)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(e, "a bigint, b bigint")).collect())
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in (100, 101, 200)} | {i: 300 for i in range(300, 340)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_predicates(spark):
    df = spark.createDataFrame([(1, True, "x", ["a"]), (None, None, None, None)], "n int, b boolean, s string, l array<string>")
    run = lambda p: [r[0] for r in df.select(compile_predicate(p, df.schema).alias("v")).collect()]
    assert run({"all": [{"fact": {"id": "b", "op": "eq", "value": True}}, {"const": None}]}) == [None, None]
    assert run({"any": [{"fact": {"id": "n", "op": "ge", "value": 1}}, {"const": None}]}) == [True, None]
    assert run({"not": {"fact": {"id": "n", "op": "present"}}}) == [False, True]
    assert run({"fact": {"id": "n", "op": "eq", "value": "1"}}) == [None, None]
    assert run({"fact": {"id": "l", "op": "contains", "value": "a"}}) == [True, False]
    assert run({"fact": {"id": "absent", "op": "in", "value": [1]}}) == [False, False]
    assert run(None) == [True, True]
    for bad in ({"x": 1}, {"fact": {"op": "eq"}}, {"fact": {"id": "n", "op": "like", "value": 1}}, {"const": 3}, {"all": [], "any": []}):
        try:
            compile_predicate(bad, df.schema)
        except ValueError:
            continue
        raise AssertionError(bad)
    assert facts_of({"all": [{"fact": {"id": "n"}}, {"not": {"fact": {"id": "s"}}}, {"fact": {"id": "n"}}]}) == ["n", "s"]


def test_records(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", None, "q")], "k string, at int, v string")
    assert {tuple(r) for r in latest(rows, ["k"], ["at"]).select("k", "v").collect()} == {("a", "z"), ("b", "q")}
    w = spark.createDataFrame([("g", i, x) for i, x in enumerate([1, 1, 1, 0])] + [("z", 1, 0)], "g string, i int, w bigint")
    assert {(r.g, r.i): r.share for r in apportion(w, "g", "i", "w", 100).collect()} == {("g", 0): 34, ("g", 1): 33, ("g", 2): 33, ("g", 3): 0, ("z", 1): 0}
    r = spark.createDataFrame([("s", "a", 5), ("s", "b", 5), ("t", "a", 5), ("t", "b", 6), ("u", "a", 1), ("u", "b", None), ("v", "a", None)], "subject string, reader string, paise bigint")
    assert {x.subject: (x.agreement, x.paise) for x in agreement(r).collect()} == {"s": ("agree", 5), "t": ("disagree", None), "u": ("one_reader", None), "v": ("no_reading", None)}
    q = spark.createDataFrame([("k", x) for x in [5, 1, 3, 3, 9]] + [("k", None)], "k string, v int")
    assert tuple(index_quantiles(q, ["k"], "v", {"lo": 0.0, "mid": 0.5, "hi": 1.0}).first()) == ("k", 5, 1, 3, 9)
    assert decode_cursor(encode_cursor("2024-01-01", "7")) == ("2024-01-01", "7")
    for bad in ("x" * 600, "%%%"):
        try:
            decode_cursor(bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_align_lines(spark):
    a = spark.createDataFrame([("p", 1, "room rent 3 days 4,000.00"), ("p", 2, "nursing 500.00"), ("p", 3, "zzz")], "page string, line_no bigint, line string")
    b = spark.createDataFrame([("p", 1, "header"), ("p", 2, "room rent 3 days 4000.00"), ("p", 3, "nursing 500.00")], "page string, line_no bigint, line string")
    assert [(r.left_no, r.right_no) for r in align_lines(a, b).orderBy("left_no").collect()] == [(1, 2), (2, 3), (3, None)]


def test_snapshots(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}")
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "n int, s string")
    sid = store.publish(df, "v1")
    assert store.publish(df.orderBy(F.desc("n")).repartition(3), "v1") == sid and store.verify(sid) and store.list() == [sid]
    assert store.publish(df.limit(1), "v1") != sid


def test_cut_and_release(spark):
    import os

    from ledgerloom.session import cut, release

    df = cut(spark.createDataFrame([(1, None)], "a int, b string"), "probe")
    path = df.inputFiles()[0][7:]
    assert df.columns == ["a", "b"] and os.path.exists(path)
    assert release(spark) >= 1 and not os.path.exists(path)


def test_generic_diff(spark):
    e = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (2, "b", None)], "snapshot bigint, key string, h string")
    p = spark.createDataFrame([(1, 2)], "from_id bigint, to_id bigint")
    assert {tuple(r) for r in diff(e, p, "key", ["h"]).collect()} == {(1, 2, "a", "changed"), (1, 2, "b", "added")}
    heads = spark.createDataFrame([("g", 1, 1, 10), ("g", 1, 2, 11), ("g", 2, 1, 12), ("h", 1, 1, 13)], "g string, d int, t int, s bigint")
    assert {tuple(r) for r in consecutive(heads, "g", "d", "t", "s").collect()} == {(11, 12)}
