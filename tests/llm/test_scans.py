import pytest

from ledgerloom.llm import scans as s

BODY = "the insurer shall pay the claim for room rent within thirty days after the settlement letter is received in writing and the nominee keeps a copy of the hospital register for day-care treatment before the cover begins "


@pytest.fixture(scope="module")
def tables(spark):
    p1 = "Meghdoot Insurance\nthe insurer shall pay the cl@im for room\nrent within thirty days af-\nter the settlement letter is received\nin day-\ncare treatment the hospital reg-\n31"
    p2 = "Meghdoot Insurance\nister is kept by the nominee\n\nRs 51,188\nthe sett1ement letter\n32"
    clause = "the nominee keeps a copy of\nMegbdoot Insurance\n- 22 -\nthe hospita| register"
    pages = [("1", "d", 1, p1), ("2", "d", 2, p2), ("1", "d", 1, p1), ("3", None, 1, ""), ("4", "d", 3, None)]
    clauses = [("c1", "d", clause), ("c2", "d", BODY * 60), ("c3", None, "kофта Zubilafo teh claimm"), ("c4", "gone", None), ("c5", "gone", "one line\nof two")]
    docs = [("d", "Some Plan Policy Wording 2020", "Meghdoot Insurance"), (None, "x", "y")]
    return (
        spark.createDataFrame([(*r, 1) for r in pages], "record_id string, document_id string, page_number int, text string, open int"),
        spark.createDataFrame([(*r, "k") for r in clauses], "record_id string, document_id string, text string, kind string"),
        spark.createDataFrame(docs, "corpus_document_id string, title string, issuer string"),
    )


def test_faults(tables):
    got = {(r.record_id, r.line_no, r.kind) for r in s.line_faults(*tables).collect()}
    furniture = {("1", 1), ("1", 7), ("2", 1), ("2", 6), ("c1", 2), ("c1", 3)}
    want = {(a, b, "furniture") for a, b in furniture} | {("1", 3, "broken_word"), ("1", 6, "broken_word"), ("1", 2, "misread"), ("2", 5, "misread"), ("c1", 4, "misread")}
    assert got == want


def test_repaired(tables):
    got = {r.record_id: r.repaired for r in s.repaired_texts(*tables).collect()}
    assert got["c1"] == "the nominee keeps a copy of the hospital register"
    assert got["1"] == "the insurer shall pay the claim for room rent within thirty days after the settlement letter is received in day-care treatment the hospital register"
    assert got["2"].split("\n\n") == ["is kept by the nominee", "Rs 51,188 the settlement letter"]
    assert got["c3"] == "kофта Zubilafo teh claimm" and got["3"] == ""


def test_empty(spark):
    p = spark.createDataFrame([], "record_id string, document_id string, page_number int, text string")
    c = spark.createDataFrame([], "record_id string, document_id string, text string")
    d = spark.createDataFrame([], "corpus_document_id string, title string, issuer string")
    assert s.line_faults(p, c, d).count() == s.repaired_texts(p, c, d).count() == 0


def test_distance():
    assert s.weighted_distance("claim", "cl@im") == pytest.approx(0.2)
    assert s.weighted_distance("modern", "modem") == pytest.approx(0.2)
    assert s.weighted_distance("claim", "claimm") == 1
    assert s.weighted_distance("group", "gruop") == 2
    assert s.skeleton("cirde") == s.skeleton("circle") and s.skeleton("gnevance") == s.skeleton("grievance")


@pytest.mark.parametrize("given, keys", [(200_000, 400_000), (0, 0)])
def test_words_below_the_share(spark, monkeypatch, given, keys):
    """A word too rare for the lexicon is still found misread, and repaired; a rare name like no other isn't. Answers given and joined are the same."""
    monkeypatch.setattr(s, "MOST_GIVEN", given)
    monkeypatch.setattr(s, "MOST_KEYS", keys)
    pages = spark.createDataFrame([("p", "d", 1, "the claim for room\nexarnine the claim\nthe claim of Zubilafo\nthe room")], "record_id string, document_id string, page_number int, text string")
    clauses = spark.createDataFrame([("big", "d", BODY * 10_000)] + [(f"e{k}", "d", f"the insurer shall examine the claim {k}") for k in range(6)], "record_id string, document_id string, text string")
    docs = spark.createDataFrame([("d", "x", "y")], "corpus_document_id string, title string, issuer string")
    assert {tuple(r) for r in s.line_faults(pages, clauses, docs).collect()} == {("page_read", "p", 2, "misread")}
    assert [r.repaired for r in s.repaired_texts(pages, clauses, docs).where("record_id = 'p'").collect()] == ["the claim for room examine the claim the claim of Zubilafo the room"]


def test_broken_words_below_the_share(spark):
    """Whether a rare word keeps its hyphen is decided by how the corpus writes it."""
    pages = spark.createDataFrame([("p", "d", 1, "the claim for super-\nvision and the with-\nprofit claim\nthe room")], "record_id string, document_id string, page_number int, text string")
    rest = [(f"e{k}", "d", f"the supervision of the claim {k} with-profit plan of vision and super and profit and with the claim") for k in range(8)]
    clauses = spark.createDataFrame([("big", "d", BODY * 10_000), ("known", "d", "super vision with profit " * 900)] + rest, "record_id string, document_id string, text string")
    docs = spark.createDataFrame([("d", "x", "y")], "corpus_document_id string, title string, issuer string")
    assert {tuple(r) for r in s.line_faults(pages, clauses, docs).collect()} == {("page_read", "p", 1, "broken_word")}
    assert [r.repaired for r in s.repaired_texts(pages, clauses, docs).where("record_id = 'p'").collect()] == ["the claim for supervision and the with-profit claim the room"]


def test_the_lexicon_does_not_shrink_with_the_corpus(spark):
    """A misread form seen three times is found in a corpus of any size."""
    docs = spark.createDataFrame([("d", "x", "y")], "corpus_document_id string, title string, issuer string")
    pages = spark.createDataFrame([(f"p{k}", "d", k, f"the claim for room {k}\nexarnine the claim\nthe room") for k in range(1, 4)], "record_id string, document_id string, page_number int, text string")
    plain = [(f"e{k}", "d", f"the insurer shall examine the claim {k}") for k in range(160)]
    for times in (1, 10):
        # each time the same corpus under other words
        more = [(f"big{t}", "d", " ".join(w + "".join(chr(97 + int(c)) for c in str(t)) for w in BODY.split()) * 400) for t in range(times)]
        clauses = spark.createDataFrame(plain + more, "record_id string, document_id string, text string")
        assert {tuple(r) for r in s.line_faults(pages, clauses, docs).collect()} == {("page_read", f"p{k}", 2, "misread") for k in range(1, 4)}


def test_rare_words_say_nothing_of_fragments():
    r = s.Reader(s.Lexicon({"the": 9, "claim": 9}, {}, {}).prepare())
    r.rare = {"hold": "hoid", "exarnine": "examine"}
    assert r.repaired("the with-\nhold claim exarnine", False, [], set()).endswith("hold claim examine")


def test_answers_given_and_joined_are_the_same(spark, monkeypatch):
    """Rare words broken over a page's end or over furniture, misread between marks, and a token that looks like the key of a broken word."""
    pages = [("p", "d", 1, "the room\nthe claim super|vision for exarnine/and;subrnit\nthe claim of super-"), ("q", "d", 2, "vision and the claim\nthe room with the claim")]
    pages = spark.createDataFrame(pages, "record_id string, document_id string, page_number int, text string")
    rest = [(f"e{k}", "d", f"the supervision of the claim {k} examine and submit the claim") for k in range(6)]
    over = [("over", "d", "the claim for super-\n- 22 -\nvision and the claim"), ("in", "d", "the claim for super-\nvision and the claim"), ("w", "d", "exarnine the claim and subrnit the claim")]
    clauses = spark.createDataFrame([("big", "d", BODY * 10_000), ("known", "d", "super vision " * 900), *over, *rest], "record_id string, document_id string, text string")
    docs = spark.createDataFrame([("d", "x", "y")], "corpus_document_id string, title string, issuer string")
    for most in (200_000, 0):
        monkeypatch.setattr(s, "MOST_GIVEN", most)
        faults = {(r.record_id, r.line_no, r.kind) for r in s.line_faults(pages, clauses, docs).collect()}
        assert faults == {("w", 1, "misread"), ("p", 2, "misread"), ("p", 3, "broken_word"), ("in", 1, "broken_word"), ("over", 1, "broken_word"), ("over", 2, "furniture")}, most
        got = {r.record_id: r.repaired for r in s.repaired_texts(pages, clauses, docs).where("record_id in ('p', 'q', 'over')").collect()}
        assert got == {
            "p": "the room the claim super|vision for examine/and;submit the claim of supervision",
            "q": "and the claim the room with the claim",
            "over": "the claim for supervision and the claim",
        }, most
