"""What changed between full snapshots: full outer join of consecutive snapshots on the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.session import cut


def canonical_hash(c: Column) -> Column:
    """One notation of a hash: lower case, no outer white space, no leading `sha256:`; empty is no hash."""
    h = F.regexp_replace(F.lower(F.trim(c)), r"^sha256:", "")
    return F.when(h != "", h)


def consecutive(heads: DataFrame, group: str, date: str, delivered: str, snapshot: str) -> DataFrame:
    """from_id, to_id of each group's snapshots in order of date; of several deliveries for one date the last
    counts, equal times are decided by the greater id. Rows without group, date or id take no part. The window
    holds one row per group and date, so it is as long as there are dates, not as there are rows."""
    last = heads.where(F.col(group).isNotNull() & F.col(date).isNotNull() & F.col(snapshot).isNotNull()).groupBy(group, date).agg(F.max(F.struct(delivered, snapshot))[snapshot].alias("to_id"))
    return last.select(F.lag("to_id").over(W.partitionBy(group).orderBy(date)).alias("from_id"), "to_id").where("from_id is not null")


def diff(entries: DataFrame, pairs: DataFrame, key: str, hashes: list[str]) -> DataFrame:
    """from_id, to_id, key, change for rows (snapshot, key, hashes...) and pairs (from_id, to_id).

    A key only in `to` is added, only in `from` removed; in both it is changed if any hash differs that both state
    (a null hash states nothing). Keys in both with no such difference give no row, nor do null keys. entries
    must have one row per snapshot and key; a snapshot without rows is an empty one."""
    e = entries.where(F.col(key).isNotNull())
    old = e.join(pairs, e["snapshot"] == pairs["from_id"]).select("from_id", "to_id", F.col(key).alias("k"), *[F.col(h).alias(f"{h}_old") for h in hashes], F.lit(True).alias("is_old"))
    new = e.join(pairs, e["snapshot"] == pairs["to_id"]).select("from_id", "to_id", F.col(key).alias("k"), *[F.col(h).alias(f"{h}_new") for h in hashes], F.lit(True).alias("is_new"))
    differs = F.lit(False)
    for h in hashes:
        differs = differs | F.coalesce(F.col(f"{h}_old") != F.col(f"{h}_new"), F.lit(False))
    change = F.when(F.col("is_old").isNull(), "added").when(F.col("is_new").isNull(), "removed").when(differs, "changed")
    return old.join(new, ["from_id", "to_id", "k"], "full").select("from_id", "to_id", F.col("k").alias(key), change.alias("change")).where("change is not null")


def build_entries(builds: DataFrame) -> DataFrame:
    """snapshot, corpus_document_id, document_hash, clause_set_hash: the documents of each build, from its list and
    its map of hashes. Null lists, maps, elements and ids add nothing. The list's document hash goes before the
    map's; of an entry listed twice the greatest stated hash counts."""
    from_list = builds.select(F.col("build_id").alias("snapshot"), F.explode("documents").alias("d")).select(
        "snapshot", F.col("d.corpus_document_id").alias("corpus_document_id"), canonical_hash(F.col("d.document_hash")).alias("lh"), F.lit(None).cast("string").alias("mh"), canonical_hash(F.col("d.clause_set_hash")).alias("ch")
    )
    from_map = builds.select(F.col("build_id").alias("snapshot"), F.explode("document_hashes").alias("corpus_document_id", "h")).select(
        "snapshot", "corpus_document_id", F.lit(None).cast("string").alias("lh"), canonical_hash(F.col("h")).alias("mh"), F.lit(None).cast("string").alias("ch")
    )
    return (
        from_list.unionByName(from_map)
        .where("corpus_document_id is not null")
        .groupBy("snapshot", "corpus_document_id")
        .agg(F.coalesce(F.max("lh"), F.max("mh")).alias("document_hash"), F.max("ch").alias("clause_set_hash"))
    )


def diff_builds(builds: DataFrame) -> DataFrame:
    """from_build, to_build, corpus_document_id, change over the builds of each source root."""
    pairs = cut(consecutive(builds, "source_root", "created_on", "delivered_at", "build_id"), "pairs")  # a row per root and date
    used = pairs.select(F.col("from_id").alias("build_id")).union(pairs.select("to_id")).distinct()
    entries = cut(build_entries(builds.select("build_id", "documents", "document_hashes").join(used, "build_id", "left_semi")), "entries")
    out = diff(entries, pairs, "corpus_document_id", ["document_hash", "clause_set_hash"])
    return out.select(F.col("from_id").alias("from_build"), F.col("to_id").alias("to_build"), "corpus_document_id", "change")
