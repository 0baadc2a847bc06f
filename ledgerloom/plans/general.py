"""Queries p1, p2 and p7: hierarchies, snapshot changes, orphan references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.hierarchy import Hierarchy
from ledgerloom.operators.orphan_refs import audit_references
from ledgerloom.operators.snapshot_diff import diff_builds
from ledgerloom.session import table


def _hierarchy(spark: SparkSession, sf: str, paths: bool = True) -> Hierarchy:
    return Hierarchy(table(spark, sf, "clause_spec"), "corpus_document_id", "label", "parent_label", "declared_at", paths=paths)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _hierarchy(spark, sf, paths=False).on_circle().withColumnRenamed("grp", "corpus_document_id")


def p1_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    h = _hierarchy(spark, sf).table()
    return h.select(F.col("grp").alias("corpus_document_id"), "label", "state", F.array_join("path", " / ").alias("path"), "depth", "root", "descendants")


def p1_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return _hierarchy(spark, sf).descendants().withColumnRenamed("grp", "corpus_document_id")


def p1_all_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """Descendants of every spec, also of those on circles and below them."""
    return _hierarchy(spark, sf).all_descendants().withColumnRenamed("grp", "corpus_document_id")


def p1_all_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _hierarchy(spark, sf).counts().withColumnRenamed("grp", "corpus_document_id")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return diff_builds(table(spark, sf, "corpus_build"))


def p2_summary(spark: SparkSession, sf: str) -> DataFrame:
    return diff_builds(table(spark, sf, "corpus_build")).groupBy("from_build", "to_build", "change").agg(F.count(F.lit(1)).alias("documents"))


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    names = ("rule_link", "clause_spec", "citation", "corpus_document", "policy_clause", "rule_pack", "nonpayable_item")
    return audit_references(*[table(spark, sf, n) for n in names])


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf).select("source_table", "record_id", "ref_key", "reason")


def p7_by_month(spark: SparkSession, sf: str) -> DataFrame:
    """Orphans per table, reason and month of the reference; a reference without time is in month null."""
    return _orphans(spark, sf).groupBy("source_table", "reason", F.date_format("at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("orphans"))


QUERIES = {f.__name__: f for f in (p1_found, p1_hierarchy, p1_descendants, p1_all_descendants, p1_all_counts, p2_found, p2_summary, p7_found, p7_by_month)}

_SPECS = r"""
specs AS (
  SELECT corpus_document_id, key, label, pkey FROM (
    SELECT corpus_document_id, lower(regexp_replace(label, '\s+', '', 'g')) AS key, label, lower(regexp_replace(parent_label, '\s+', '', 'g')) AS pkey,
           row_number() OVER (PARTITION BY corpus_document_id, lower(regexp_replace(label, '\s+', '', 'g')) ORDER BY declared_at DESC NULLS LAST, parent_label DESC NULLS LAST, label DESC) AS n
    FROM clause_spec WHERE corpus_document_id IS NOT NULL AND regexp_replace(label, '\s+', '', 'g') <> '')
  WHERE n = 1),
links AS (SELECT s.corpus_document_id, s.key, s.label, p.key AS pkey, p.label AS plabel FROM specs s LEFT JOIN specs p ON s.corpus_document_id = p.corpus_document_id AND s.pkey = p.key)
"""
_REACH = "reach AS (SELECT corpus_document_id, key, label, pkey AS up FROM links WHERE pkey IS NOT NULL UNION SELECT r.corpus_document_id, r.key, r.label, l.pkey FROM reach r JOIN links l ON r.corpus_document_id = l.corpus_document_id AND r.up = l.key WHERE l.pkey IS NOT NULL)"
_DOWN = """down AS (
  SELECT corpus_document_id, key, label, label AS path, 0::BIGINT AS depth, label AS root, [label] AS chain FROM links WHERE pkey IS NULL
  UNION ALL
  SELECT l.corpus_document_id, l.key, l.label, d.path || ' / ' || l.label, d.depth + 1, d.root, list_append(d.chain, l.label) FROM down d JOIN links l ON l.corpus_document_id = d.corpus_document_id AND l.pkey = d.key)"""
_ROUND = """walk AS (
  SELECT corpus_document_id, key, label, pkey AS up, plabel AS ancestor, 1::BIGINT AS distance, [pkey] AS seen FROM links WHERE pkey IS NOT NULL
  UNION ALL
  SELECT w.corpus_document_id, w.key, w.label, l.pkey, l.plabel, w.distance + 1, list_append(w.seen, l.pkey) FROM walk w JOIN links l ON l.corpus_document_id = w.corpus_document_id AND l.key = w.up
  WHERE l.pkey IS NOT NULL AND NOT list_contains(w.seen, l.pkey))"""
_DIFF = r"""
heads AS (
  SELECT lag(build_id) OVER (PARTITION BY source_root ORDER BY created_on) AS from_build, build_id AS to_build FROM (
    SELECT source_root, created_on, build_id, row_number() OVER (PARTITION BY source_root, created_on ORDER BY delivered_at DESC NULLS LAST, build_id DESC) AS n
    FROM corpus_build WHERE source_root IS NOT NULL AND created_on IS NOT NULL AND build_id IS NOT NULL)
  WHERE n = 1),
pairs AS (SELECT * FROM heads WHERE from_build IS NOT NULL),
raw AS (
  SELECT build_id, d.corpus_document_id AS doc, d.document_hash AS lh, NULL AS mh, d.clause_set_hash AS ch FROM (SELECT build_id, unnest(documents) AS d FROM corpus_build)
  UNION ALL SELECT build_id, m.key, NULL, m.value, NULL FROM (SELECT build_id, unnest(map_entries(document_hashes)) AS m FROM corpus_build)),
norm AS (SELECT build_id, doc, nullif(regexp_replace(lower(trim(lh)), '^sha256:', ''), '') AS lh, nullif(regexp_replace(lower(trim(mh)), '^sha256:', ''), '') AS mh, nullif(regexp_replace(lower(trim(ch)), '^sha256:', ''), '') AS ch FROM raw WHERE doc IS NOT NULL),
entries AS (SELECT build_id, doc, coalesce(max(lh), max(mh)) AS dh, max(ch) AS ch FROM norm GROUP BY 1, 2),
was AS (SELECT p.*, e.doc, e.dh, e.ch FROM pairs p JOIN entries e ON e.build_id = p.from_build),
now AS (SELECT p.*, e.doc, e.dh, e.ch FROM pairs p JOIN entries e ON e.build_id = p.to_build),
found AS (
  SELECT coalesce(w.from_build, n.from_build) AS from_build, coalesce(w.to_build, n.to_build) AS to_build, coalesce(w.doc, n.doc) AS corpus_document_id,
         CASE WHEN w.doc IS NULL THEN 'added' WHEN n.doc IS NULL THEN 'removed' WHEN coalesce(w.dh <> n.dh, FALSE) OR coalesce(w.ch <> n.ch, FALSE) THEN 'changed' END AS change
  FROM was w FULL JOIN now n ON w.from_build = n.from_build AND w.to_build = n.to_build AND w.doc = n.doc)
"""
_ORPHANS = r"""
last AS (
  SELECT corpus_document_id, label, corpus_document_id || '#' || label AS id, declared_at, references_to, deleted_at, first FROM (
    SELECT *, min(declared_at) OVER (PARTITION BY corpus_document_id, label) AS first, row_number() OVER (PARTITION BY corpus_document_id, label ORDER BY declared_at DESC) AS n FROM clause_spec)
  WHERE n = 1),
refs AS (
  SELECT 'rule_link' AS source_table, link_id::VARCHAR AS record_id, source_ref.clause_id AS ref_key, 'spec' AS kind, lower(trim(source_ref.clause_id)) AS key, linked_at AS at FROM rule_link
  UNION ALL SELECT 'clause_spec', id, r, 'instrument', lower(regexp_replace(r, '[^\p{L}\p{N}]', '', 'g')), declared_at FROM (SELECT id, declared_at, unnest(references_to) AS r FROM last)
  UNION ALL SELECT 'citation', citation_id::VARCHAR, ref_id, CASE ref_type WHEN 'policy_clause' THEN 'clause' WHEN 'rule_version' THEN 'rule' WHEN 'document' THEN 'document' WHEN 'item_entry' THEN 'item' END, lower(trim(ref_id)), cited_at FROM citation),
parents AS (
  SELECT kind, key, min(came) AS came, CASE WHEN count(gone) = count(*) THEN max(gone) END AS gone FROM (
    SELECT 'spec' AS kind, lower(trim(id)) AS key, first AS came, deleted_at AS gone FROM last
    UNION ALL SELECT 'instrument', lower(regexp_replace(reference, '[^\p{L}\p{N}]', '', 'g')), ingested_at, deleted_at FROM corpus_document
    UNION ALL SELECT 'document', lower(trim(corpus_document_id)), ingested_at, deleted_at FROM corpus_document
    UNION ALL SELECT 'clause', lower(trim(clause_id)), ingested_at, deleted_at FROM policy_clause
    UNION ALL SELECT 'rule', lower(trim(rule_id)), NULL, NULL FROM rule_pack
    UNION ALL SELECT 'item', lower(trim(item_id)), NULL, NULL FROM nonpayable_item)
  WHERE key <> '' GROUP BY 1, 2),
found AS (
  SELECT DISTINCT r.source_table, r.record_id, r.ref_key, r.at, CASE WHEN p.key IS NULL THEN 'missing' WHEN p.gone <= r.at THEN 'deleted' WHEN p.came > r.at THEN 'late' END AS reason
  FROM refs r LEFT JOIN parents p ON r.kind = p.kind AND r.key = p.key WHERE r.key <> '' AND r.kind IS NOT NULL)
"""

ORACLE = {
    "p1_found": f"WITH RECURSIVE {_SPECS}, {_REACH} SELECT DISTINCT corpus_document_id, label FROM reach WHERE up = key",
    "p1_hierarchy": f"""WITH RECURSIVE {_SPECS}, {_REACH}, {_DOWN},
      kids AS (SELECT corpus_document_id, up AS key, count(*) AS n FROM reach GROUP BY 1, 2),
      ring AS (SELECT DISTINCT corpus_document_id, key FROM reach WHERE up = key)
      SELECT l.corpus_document_id, l.label, CASE WHEN d.key IS NOT NULL THEN 'tree' WHEN r.key IS NOT NULL THEN 'circle' ELSE 'below_circle' END AS state,
             d.path, d.depth, d.root, CASE WHEN d.key IS NOT NULL THEN coalesce(k.n, 0) END AS descendants
      FROM links l LEFT JOIN down d ON d.corpus_document_id = l.corpus_document_id AND d.key = l.key
      LEFT JOIN kids k ON k.corpus_document_id = l.corpus_document_id AND k.key = l.key LEFT JOIN ring r ON r.corpus_document_id = l.corpus_document_id AND r.key = l.key""",
    "p1_descendants": f"WITH RECURSIVE {_SPECS}, {_DOWN} SELECT corpus_document_id, chain[i] AS ancestor, label AS descendant, depth + 1 - i AS distance FROM down, unnest(range(1, depth + 1)) AS t(i)",
    "p1_all_descendants": f"WITH RECURSIVE {_SPECS}, {_ROUND} SELECT corpus_document_id, ancestor, label AS descendant, distance FROM walk",
    "p1_all_counts": f"""WITH RECURSIVE {_SPECS}, {_REACH}, kids AS (SELECT corpus_document_id, up AS key, count(*) AS n FROM reach GROUP BY 1, 2)
      SELECT l.corpus_document_id, l.label, coalesce(k.n, 0) AS descendants FROM links l LEFT JOIN kids k ON k.corpus_document_id = l.corpus_document_id AND k.key = l.key""",
    "p2_found": f"WITH {_DIFF} SELECT * FROM found WHERE change IS NOT NULL",
    "p2_summary": f"WITH {_DIFF} SELECT from_build, to_build, change, count(*) AS documents FROM found WHERE change IS NOT NULL GROUP BY 1, 2, 3",
    "p7_found": f"WITH {_ORPHANS} SELECT source_table, record_id, ref_key, reason FROM found WHERE reason IS NOT NULL",
    "p7_by_month": f"WITH {_ORPHANS} SELECT source_table, reason, strftime(found.at, '%Y-%m') AS month, count(*) AS orphans FROM found WHERE reason IS NOT NULL GROUP BY 1, 2, 3",
}
