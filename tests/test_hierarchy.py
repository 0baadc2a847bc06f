import random

import pytest

from ledgerloom.operators.hierarchy import Hierarchy

SCHEMA = "doc string, label string, parent string, at int, id int, grp string"


def build(spark, rows, **kw):
    # extra columns that clash with names used inside
    return Hierarchy(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA), "doc", "label", "parent", "at", **kw)


def brute(rows):
    last = {}
    norm = lambda x: "".join((x or "").lower().split())
    for d, label, p, at in rows:
        if d is None or not norm(label):
            continue
        k, v = (d, norm(label)), (at if at is not None else -1, p or "", label, p)
        last[k] = max(last.get(k, v), v)
    par = {k: ((k[0], norm(v[3])) if v[3] and (k[0], norm(v[3])) in last else None) for k, v in last.items()}
    out = {}
    for k in last:
        path, x = [], k
        while x is not None and x not in path:
            path.append(x)
            x = par[x]
        if x is None:
            out[k[0], last[k][2]] = ("tree", [last[y][2] for y in reversed(path)], len(path) - 1)
        else:
            out[k[0], last[k][2]] = ("circle" if x == k else "below_circle", None, None)
    return out


def check(spark, rows, **kw):
    h = build(spark, rows, **kw)
    want = brute(rows)
    got = {(r.grp, r.label): (r.state, r.path, r.depth) for r in h.table().collect()}
    assert got == want
    assert {tuple(r) for r in h.on_circle().collect()} == {k for k, v in want.items() if v[0] == "circle"}
    pairs = {(r.grp, r.ancestor, r.descendant, r.distance) for r in h.descendants().collect()}
    assert pairs == {(k[0], a, k[1], v[2] - i) for k, v in want.items() if v[0] == "tree" for i, a in enumerate(v[1][:-1])}


@pytest.mark.parametrize("split", [1, 3, 1000])
def test_random_graphs(spark, split):
    r = random.Random(split)
    rows = [("a", str(i), str(r.randrange(-8, 60)), 1) for i in range(60)]
    rows += [("b", str(i), str(i + 1) if i < 39 else None, 1) for i in range(40)]
    rows += [("c", str(i), str((i + 1) % 13), 1) for i in range(13)] + [("c", "x", "3", 1), ("c", "y", "x", 1)]
    check(spark, rows, split_every=split)


def test_dirty_rows(spark):
    rows = [("a", "P 1", None, 1), ("a", "p1.A", "p 1", 1), ("a", "p1.A", "p 1", 1), ("a", "q", "gone", 5), ("a", "q", "q", 9), (None, "z", None, 1), ("a", None, "q", 1), ("a", "  ", None, 1), ("b", "p1", "", 1), ("a", "w", "P1", None), ("b", "long" * 5000, "P1", 1)]
    check(spark, rows)


def test_empty(spark):
    h = build(spark, [])
    assert h.table().count() == h.on_circle().count() == h.descendants().count() == 0


@pytest.mark.parametrize("split", [1, 3, 1000])
def test_descendants_on_and_below_circles(spark, split):
    r = random.Random(split + 7)
    par = {("a", str(i)): ("a", str(r.randrange(-3, 50))) for i in range(50)}
    par |= {("c", str(i)): ("c", str((i + 1) % 13)) for i in range(13)} | {("c", "x"): ("c", "3"), ("c", "y"): ("c", "x"), ("c", "z"): ("c", "x"), ("s", "1"): ("s", "1"), ("s", "2"): ("s", "1")}
    h = build(spark, [(d, x, p[1], 1) for (d, x), p in par.items()], split_every=split)
    want = set()
    for k in par:
        seen, up = [], par[k]
        while up in par and up not in seen:
            seen.append(up)
            up = par[up]
        want |= {(k[0], a[1], k[1], n + 1) for n, a in enumerate(seen)}
    got = [tuple(x) for x in h.all_descendants().collect()]
    assert set(got) == want and len(got) == len(want)
    assert {(x.grp, x.label): x.descendants for x in h.counts().collect()} == {k: sum((d, a) == k for d, a, _, _ in want) for k in par}
