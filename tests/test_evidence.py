import pytest

from ledgerloom.operators.evidence import verify_quotes
from ledgerloom.sources.manifests import read_manifest, read_rule_pack

TEXT = "The insurer shall not reduce the claim below Rs 1,50,000 unless the policyholder agrees in writing. A co-payment of 10 per cent applies to room rent."


def test_tiers(spark):
    cases = {
        "shall not reduce the claim": "EXACT",
        "the": "AMBIGUOUS",
        "SHALL  NOT reduce\nthe claim": "NORMALISED",
        "shall not reduce the clairn below Rs 1,50,000 unless the policyholder agrees": "FUZZY",
        "shall not reduce the clairn below Rs 1,60,000 unless the policyholder agrees": "REJECTED",
        "shall reduce the claim below Rs 1,50,000 unless the policyholder agrees in writing": "REJECTED",
        "may not reduce the claim below Rs 1,50,000 unless the policyholder agrees": "REJECTED",
        "nothing of the kind was ever printed": "REJECTED",
        "x": "EXACT" if "x" in TEXT else "REJECTED",
    }
    rows = [(i, "k", q, "t") for i, q in enumerate(cases)] + [(0, "k", list(cases)[0], "t"), (50, "gone", "q", "t"), (51, "k", "", "t"), (52, "k", None, "t"), (53, None, "q", "t")]
    c = spark.createDataFrame(rows, "citation_id int, key string, quote string, text string")
    t = spark.createDataFrame([("k", TEXT, "q"), (None, "x", "q"), ("n", None, "q")], "key string, text string, quote string")
    got = {r.citation_id: r.method for r in verify_quotes(c, t).collect()}
    assert got == dict(enumerate(cases.values())) | {50: "NO_TEXT", 53: "NO_TEXT"}
    assert verify_quotes(c.limit(0), t).count() == 0


def test_manifests(spark, tmp_path):
    good = tmp_path / "pack.toml"
    good.write_text('[[rule]]\nid="A"\nversion=1\ninstrument="X/1"\nquote="q"\neffective_from=2024-01-01\n[[rule]]\nid="B"\nversion=2\ninstrument="X/1"\nkind="contested"\nstatus="verified"\n')
    rows = {r.rule_id: r.rule_status for r in read_rule_pack(spark, str(good)).collect()}
    assert rows == {"A": "verified", "B": "contested"}
    for bad in ('[[rule]]\nid="A"\nversion=1\n', '[[rule]]\nid="A"\nversion=1\ninstrument="X"\n', good.read_text() + '[[rule]]\nid="A"\nversion=1\ninstrument="X"\nquote="q"\n'):
        f = tmp_path / "bad.toml"
        f.write_text(bad)
        with pytest.raises(ValueError):
            read_rule_pack(spark, str(f))
    doc = tmp_path / "doc.toml"
    doc.write_text('[document]\nid="d"\ntitle="T"\nsource_type="s"\n[[clause]]\nlabel="1"\nanchor="a"\n[[clause]]\nlabel="1.1"\nanchor="b"\nparent="1"\n')
    assert [(r.label, r.parent_label) for r in read_manifest(spark, str(doc)).orderBy("label").collect()] == [("1", None), ("1.1", "1")]
