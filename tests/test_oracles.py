"""Every query that has an SQL oracle, against it; the others have to run."""

import pytest

import __spark_entry__ as entry
from ledgerloom.plans import registry
from tests.compare import compare


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, name):
    rows, ok, _, why = compare(spark, sf, name, registry.QUERIES[name], registry.ORACLE.get(name))
    assert ok is not False, why


def test_entry(spark):
    assert entry.entry(spark).columns == ["from_build", "to_build", "corpus_document_id", "change"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
