import duckdb
import numpy as np
import pytest

from ledgerloom.llm import mixing as mx
from ledgerloom.llm import quality as ql
from ledgerloom.llm.queries import ORACLE, QUERIES
from tests.compare import compare

DOCS = "doc_id bigint, text string, lang string, source string, issuer string, tokens int"


def test_mix(spark):
    rows = [(i, "word " * (5 + i % 40), "en", ["a_b", "A B", "c", "D"][i % 4], f"i{i % 3}", 0) for i in range(1200)]
    rows += [(5000, None, "en", "c", None, 0), (5001, "", None, "c", None, 0), (5002, "x", "en", None, None, 0), (5003, "x", "en", "other", None, 0), (5004, "long " * 3000, "hi", "d", None, 0)]
    targets = [("a b", 0.5, 1), ("C", 0.3, 3), ("d", 0.2, 2), ("absent", 0.1, 2)]
    docs, t = spark.createDataFrame(rows, DOCS), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    got = {r.source: r for r in mx.mix_report(docs, t).collect()}
    assert set(got) == {"a_b", "c", "d", "absent"} and got["absent"].tokens_drawn == 0
    for s, share, cap in (("a_b", 0.5, 1), ("c", 0.3, 3), ("d", 0.2, 2)):
        assert got[s].share_reached == pytest.approx(share, abs=0.01) and got[s].repeats_used <= cap
    uses = {r.doc_id: r.uses for r in mx.draw(docs, t)[0].collect()}
    assert max(uses.values()) <= 3 and not {5000, 5001, 5002, 5003} & set(uses)
    assert uses == {r.doc_id: r.uses for r in mx.draw(docs.repartition(7), t)[0].collect()}
    assert mx.mix_report(docs.limit(0), t).count() == 4 and mx.mix_report(docs, t.limit(0)).count() == 0


def test_draw_adds_up_and_cells_raked_as_a_table(spark, sf, monkeypatch):
    docs, t = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "mix_target"))
    report = {r.source: r for r in mx.mix_report(docs, t).collect()}
    drawn = mx.draw(docs, t)[0].toPandas()
    for s, r in report.items():
        own = drawn[drawn.source == s]
        assert (own.uses * own.tokens).sum() == r.tokens_drawn and own.tokens.sum() == r.tokens_available and (own.uses.max() if len(own) else 0) == r.repeats_used <= r.max_repeats
        assert abs(r.share_reached - r.target_share) < 0.02
    marginals = mx.mix_marginals(docs, t).toPandas()
    assert (marginals.groupby("marginal").share_reached.sum() - 1).abs().max() < 1e-9
    monkeypatch.setattr(mx, "MOST_CELLS", 0)
    monkeypatch.setattr(mx, "TABLE_ROUNDS", 3)
    for r in mx.mix_report(docs, t).collect():
        assert abs(r.share_reached - r.target_share) < 0.02 and r.repeats_used <= r.max_repeats


def test_quality(spark):
    prose = "The insurer shall pay the claim for the room when the bill is received and the letter of the hospital is in the file, but not before the review of the case has ended. "
    rows = [(i, prose + f"This is case {i} of the year and it is the one for which the money was paid to the person.", ["en", None, "und", "EN-in"][i % 4], "s", None, 0) for i in range(80)]
    rows += [(100, "room\t3\t500\nnursing\t2\t400", "en", "s", None, 0), (101, "• Typhoid\n• Asthma\n• Renal stones", "en", "s", None, 0), (102, "8c99=0x18 05eb:NaN " * 9, None, "s", None, 0), (103, None, "en", "s", None, 0), (104, "  \n", "en", "s", None, 0), (105, "the of " * 500, "en", "s", None, 0)]
    out = {r.doc_id: r for r in ql.scored(ql.statistics(spark.createDataFrame(rows, DOCS))).collect()}
    assert {k for k, r in out.items() if r.words and not r.prose} == {100, 101, 102, 105}
    assert out[103].words == out[104].words == 0 and out[103].common_share is None and not out[104].prose
    assert out[100].words == 6 and out[101].line_end_share == 0 and out[0].language == "en"
    assert ql.scored(ql.statistics(spark.createDataFrame([], DOCS))).count() == 0
    # a rare language has no common words and no scores
    few = ql.scored(ql.statistics(spark.createDataFrame([(1, "un deux trois", "fr", "s", None, 0), (2, "== == ==", "fr", "s", None, 0)], DOCS))).collect()
    assert all(r.prose and r.common_share is None and r.words_z is None and r.tails == [] for r in few)


def test_common_words_joined_or_given(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    given = sorted(map(tuple, ql.statistics(docs).collect()), key=repr)
    monkeypatch.setattr(ql, "MOST_GIVEN", 0)
    assert sorted(map(tuple, ql.statistics(docs).collect()), key=repr) == given


def test_found_on_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id for r in QUERIES["p10_found"](spark, sf).collect()}
    labels = duckdb.sql(f"select distinct doc_id, kind from '{sf}/doc_label.parquet'").fetchall()
    wrong = [x for x in labels if (x[0] in got) == (x[1] == "prose")]
    assert len(wrong) <= 0.02 * len(labels)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    rows, ok, _, why = compare(spark, sf, name, QUERIES[name], ORACLE.get(name))
    assert ok is not False, why


def test_rates_of_arrays_and_of_a_table_are_the_same(spark, monkeypatch):
    """As many rounds of either; here, cells at their caps in three of them."""
    assert mx.TABLE_ROUNDS == mx.ROUNDS
    monkeypatch.setattr(mx, "ROUNDS", 3)
    monkeypatch.setattr(mx, "TABLE_ROUNDS", 3)
    sources, langs, topics = (np.array([k // 4 % 2 for k in range(8)]), np.array([k // 2 % 2 for k in range(8)]), np.array([k % 2 for k in range(8)]))
    tokens, target, cap = np.array([900, 40, 5, 300, 7, 800, 60, 2], float), np.array([1200.0, 2300.0]), np.array([1.0, 3.0])
    want = mx._rake(sources, langs, topics, tokens, target, cap)
    cells = spark.createDataFrame([(f"s{a}", f"l{b}", f"t{c}", int(n)) for a, b, c, n in zip(sources, langs, topics, tokens)], "source string, language string, topic string, tokens bigint").coalesce(1)
    goals = spark.createDataFrame([(f"s{k}", float(cap[k]), float(target[k])) for k in range(2)], "source string, cap double, target double")
    got = {(r.source, r.language, r.topic): r.rate for r in mx._rake_table(cells, goals).collect()}
    assert [got[f"s{a}", f"l{b}", f"t{c}"] for a, b, c in zip(sources, langs, topics)] == pytest.approx(want.tolist(), rel=1e-9)
