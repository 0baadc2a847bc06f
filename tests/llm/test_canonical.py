import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import canonical as c

ODD = "aeoiAI 0-'\n" + "аеоісроЅΤοօԁ" + "ｅＡ１０　" + "ééñế̈" + "​‍﻿\xad⁠‏" + "\xa0  " + "ﬁﬃ²½①" + "‐‑–’" + "की।가각ᅡᆨ" + "й"


def whole(text):
    """The same form made of the whole text at once."""
    return c.canon_of(tuple(c.LOOK_ALIKE.items())).segment(text)


def test_look_alikes_of_the_confusables_data(spark):
    table = c.look_alikes(spark)
    assert len(table) > 200 and all(len(v) == 1 for v in table.values())
    # Cherokee, Lisu, Coptic, Greek and Latin letters
    for a, b in [("Ꭺ", "A"), ("Ꮯ", "C"), ("ꓐ", "B"), ("ꓑ", "P"), ("Ⲟ", "O"), ("ο", "o"), ("Ϝ", "F"), ("ɩ", "i"), ("а", "a"), ("Ӏ", "I"), ("ӏ", "l")]:
        assert table[a] == b
    assert not {"é", "ø", "ß", "अ", "ا", "–", "٠", "œ"} & set(table)
    canon = c.Canon(table)
    text = "Ꭺ ꓐank pаys ｆor “cafés” अस्पताल"
    assert canon.form(text) == canon.segment(text) == "A Bank pays for “cafés” अस्पताल" and canon.form(canon.form(text)) == canon.form(text)


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(ODD), st.characters(codec="utf-8", max_codepoint=0x1FFFF)), max_size=30))
def test_segments_agree_with_whole_text(text):
    got = c.canonical(text)
    assert got == whole(text)
    assert c.canonical(got) == got


def test_cases():
    same = [("cаfé", "café"), ("ｒｅｎｔ", "rent"), ("zero​width", "zerowidth"), ("a\xa0b", "a b"), ("oﬃce", "office"), ("non‑payable", "non-payable"), ("Ｎo", "No")]
    assert all(c.canonical(a) == c.canonical(b) == b for a, b in same)
    differ = [("cafe", "café"), ("A", "a"), ("10", "1O"), ("x²", "x2"), ("a–b", "a-b"), ("l", "1"), ("½", "1/2")]
    assert all(c.canonical(a) != c.canonical(b) for a, b in differ)
    assert c.canonical(None) is None and c.canonical("") == ""


def test_quotes(spark):
    cites = [(1, " cl-1", "rеnt due"), (2, "CL-1 ", "rent due"), (3, "CL-1", "Rent due"), (4, "CL-1", ""), (5, "CL-1", None), (6, None, "rent"), (7, "CL-9", "rent"), (1, " cl-1", "rеnt due"), (8, "CL-2", "x​y"), (9, "CL-3", "a"), (10, "CL-1", "​")]
    cites += [(100 + i, "CL-1", "rеnt" if i % 2 else "rent") for i in range(3000)]
    texts = [("CL-1", "the rent due today"), ("CL-1", "the rent due today"), ("CL-2", "xy" * 30_000), ("CL-3", None), (None, "rent")]
    a = spark.createDataFrame([(*r, "k", 0) for r in cites], "citation_id bigint, ref_id string, quote string, key string, t int")
    b = spark.createDataFrame([(*r, "k") for r in texts], "clause_id string, original_text string, key string")
    got = {tuple(r) for r in c.quotes_only_alike(a, b).collect()}
    assert got == {(1, "CL-1"), (8, "CL-2")} | {(100 + i, "CL-1") for i in range(1, 3000, 2)}
    assert c.quotes_only_alike(a.limit(0), b).count() == 0
    out = c.canonical_texts(spark.createDataFrame([("é", 1), ("plain", 2), (None, 3), ("", 4)], "t string, n int"), "t")
    assert {r.n: r.canonical for r in out.collect()} == {1: "é", 2: "plain", 3: None, 4: ""}


def test_found_against_brute_force(spark, sf):
    from ledgerloom.llm.queries import p3_found

    q = [r for r in spark.read.parquet(f"{sf}/citation.parquet").where("ref_type = 'policy_clause' and quote <> ''").select("citation_id", "ref_id", "quote").distinct().collect()]
    t = {}
    for r in spark.read.parquet(f"{sf}/policy_clause.parquet").where(F.col("original_text").isNotNull()).select("clause_id", "original_text").distinct().collect():
        t.setdefault(r.clause_id.lower().strip(), []).append(r)
    want = {(x.citation_id, y.clause_id) for x in q for y in t.get((x.ref_id or "").lower().strip(), []) if x.quote not in y.original_text and whole(x.quote) and whole(x.quote) in whole(y.original_text)}
    assert {tuple(r) for r in p3_found(spark, sf).collect()} == want and want
