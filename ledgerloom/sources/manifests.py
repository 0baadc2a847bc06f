"""Rule packs and document manifests in TOML, read on the driver and validated before they become tables."""

from __future__ import annotations

import tomllib
from datetime import date

from pyspark.sql import DataFrame, SparkSession

RULE_PACK = "rule_id string, rule_version int, title string, instrument_ref string, citation string, quote string, kind string, effect string, rule_status string, effective_from date, superseded_on date"
MANIFEST = "corpus_document_id string, title string, source_type string, issuer string, reference string, label string, anchor string, parent_label string"


def _need(entry: dict, keys: tuple[str, ...], where: str) -> None:
    if lacking := [k for k in keys if not entry.get(k)]:
        raise ValueError(f"{where}: missing {', '.join(lacking)}")


def read_rule_pack(spark: SparkSession, path: str) -> DataFrame:
    """One row per [[rule]] of a TOML file. ValueError for a rule without id, version or instrument, for one with a status but no quote, and for two of one
    id and version. A contested kind always has the status contested; the status is verified where none is given."""
    with open(path, "rb") as f:
        rules = tomllib.load(f).get("rule", [])
    rows, seen = [], set()
    for r in rules:
        _need(r, ("id", "version", "instrument"), f"rule {r.get('id')}")
        key = (r["id"], int(r["version"]))
        if key in seen:
            raise ValueError(f"rule {key} is given twice")
        seen.add(key)
        status = "contested" if r.get("kind") == "contested" else r.get("status", "verified")
        if status == "verified" and not r.get("quote"):
            raise ValueError(f"rule {key}: verified without a quote")
        day = lambda k: r[k] if isinstance(r.get(k), date) else None  # noqa: B023, E731
        rows.append((*key, r.get("title"), r["instrument"], r.get("citation"), r.get("quote"), r.get("kind"), r.get("effect"), status, day("effective_from"), day("superseded_on")))
    return spark.createDataFrame(rows, RULE_PACK)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per [[clause]] of a document's manifest, with the document's fields. ValueError for a missing id, title or source type, for clauses without label
    or anchor, and for a label given twice."""
    with open(path, "rb") as f:
        doc = tomllib.load(f)
    head = doc.get("document", {})
    _need(head, ("id", "title", "source_type"), "document")
    rows, labels = [], set()
    for c in doc.get("clause", []):
        _need(c, ("label", "anchor"), f"clause {c.get('label')}")
        if c["label"] in labels:
            raise ValueError(f"clause {c['label']} is given twice")
        labels.add(c["label"])
        rows.append((head["id"], head["title"], head["source_type"], head.get("issuer"), head.get("reference"), c["label"], c["anchor"], c.get("parent")))
    return spark.createDataFrame(rows, MANIFEST)
