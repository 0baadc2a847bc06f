"""References to records that do not exist, by bitmaps per key range and month.

Keys are dictionary-encoded: the distinct keys of both sides are spread over ranges by a hash and numbered
inside their range, so a key is an integer (range, bit) and every range is one bitmap of at most RANGE_BITS bits. For each
range and month there is a bitmap of the keys referred to, and parents enter a bitmap of the month they arrived in and one of
the month they were deleted in. Running ORs over the months give what was there for a whole month, and reference AND-NOT
parent leaves the suspects: keys absent for at least a part of the month. The suspects' bits are decoded, and only their
references meet the parents' exact times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import cut

RANGE_BITS = 32_768  # what bitmap_construct_agg holds
FILL = RANGE_BITS // 4  # keys expected in a range; a hash spreads them, so a range never comes near RANGE_BITS
HOT_SHARE = 1_000  # a key with more than 1/HOT_SHARE of all references is salted; there are fewer than HOT_SHARE such keys


def plain_key(c: Column) -> Column:
    """Compared without case and outer white space."""
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def alnum_key(c: Column) -> Column:
    """Compared by letters and digits only, without case."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def _month(c: Column) -> Column:
    return (F.year(c) * 12 + F.month(c)).cast("int")


def _bits(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.uint8)


def _suspects(pdf: pd.DataFrame) -> pd.DataFrame:
    """One range: at most three bitmaps of RANGE_BITS a month."""
    rng, size = int(pdf["rng"].iloc[0]), RANGE_BITS // 8
    months = sorted(set(pdf["month"]))
    by = {(r, m): _bits(b) for r, m, b in zip(pdf["role"], pdf["month"], pdf["bitmap"])}
    there, gone, none = np.zeros(size, np.uint8), np.zeros(size, np.uint8), np.zeros(size, np.uint8)
    out_m: list[np.ndarray] = []
    out_b: list[np.ndarray] = []
    for m in months:
        gone = gone | by.get(("gone", m), none)
        if (refs := by.get(("ref", m))) is not None:
            left = refs & ~(there & ~gone)
            bits = np.flatnonzero(np.unpackbits(left, bitorder="little"))
            out_m.append(np.full(len(bits), m))
            out_b.append(bits)
        there = there | by.get(("came", m), none)
    cat = (lambda x: np.concatenate(x) if x else np.array([], np.int64))
    month, bit = cat(out_m), cat(out_b)
    return pd.DataFrame({"rng": np.full(len(bit), rng, np.int64), "bit": bit.astype(np.int64), "month": month.astype(np.int32)})


def encode(keys: DataFrame, by: list[str]) -> DataFrame:
    """keys (distinct) with rng and bit. The number of ranges follows the number of keys; numbering in a range is by the
    order of keys, a window of about FILL rows."""
    from pyspark.sql import Window as W

    ranges = max(1, -(-keys.count() // FILL))
    return keys.withColumn("rng", F.pmod(F.xxhash64(*by), F.lit(ranges)).cast("bigint")).withColumn("bit", (F.row_number().over(W.partitionBy("rng").orderBy(*by)) - 1).cast("bigint"))


def _bitmap(rows: DataFrame, role: str, month: Column) -> DataFrame:
    return rows.groupBy("rng", month.alias("month")).agg(F.bitmap_construct_agg("bit").alias("bitmap")).select("rng", "month", F.lit(role).alias("role"), "bitmap")


def orphans(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """source_table, record_id, ref_key, at, reason of the references that have no living parent at their time.

    refs: source_table, record_id, ref_key (as stored), kind (the table referred to), key (normalised), at; rows whose key is null or empty are no
    references. parents: kind, key, arrived_at, deleted_at; several rows of one key are one parent that arrived at the
    earliest and was deleted at the latest of their times, and not at all if one of them wasn't. A null arrived_at means it was always there.
    reason is `missing` (no parent), else `deleted` (deleted_at not after at), else `late` (arrived_at after at). Without a
    time a reference can only be missing. Exact copies give one row."""
    refs = refs.where("key is not null and key <> ''").select("source_table", "record_id", "ref_key", "kind", "key", "at")
    month = F.coalesce(_month(F.col("at")), F.lit(0))
    seen = cut(refs.groupBy("source_table", "kind", "key", month.alias("month")).agg(F.count(F.lit(1)).alias("n")), "seen")
    known = cut(
        parents.where("key is not null and key <> ''")
        .groupBy("kind", "key")
        .agg(
            F.when(F.max(F.col("arrived_at").isNull()), F.lit(None)).otherwise(F.min("arrived_at")).alias("arrived_at"),
            F.when(F.max(F.col("deleted_at").isNull()), F.lit(None)).otherwise(F.max("deleted_at")).alias("deleted_at"),
        ),
        "known",
    )
    codes = cut(encode(seen.select("kind", "key").union(known.select("kind", "key")).distinct(), ["kind", "key"]), "codes")
    coded = known.join(codes, ["kind", "key"])
    # arrived before all months if always there; references without a time are looked at in month 0, before any arrival
    bitmaps = (
        _bitmap(seen.join(codes, ["kind", "key"]), "ref", F.col("month"))
        .unionByName(_bitmap(coded, "came", F.coalesce(_month(F.col("arrived_at")), F.lit(-1))))
        .unionByName(_bitmap(coded.where("deleted_at is not null"), "gone", _month(F.col("deleted_at"))))
    )
    bits = bitmaps.groupBy("rng").applyInPandas(_suspects, "rng bigint, bit bigint, month int")
    # decode, and give the suspects their parents' times
    counts = seen.groupBy("kind", "key", "month").agg(F.sum("n").alias("n"))
    suspects = cut(
        bits.join(codes, ["rng", "bit"]).select("kind", "key", "month").join(counts, ["kind", "key", "month"]).join(known.withColumn("known", F.lit(True)), ["kind", "key"], "left"),
        "suspects",
    )
    return _exact(refs.withColumn("month", month), suspects)


def _exact(refs: DataFrame, suspects: DataFrame) -> DataFrame:
    total = suspects.agg(F.sum("n")).first()[0] or 0
    hot = suspects.where(F.col("n") > max(1_000, total // HOT_SHARE)).select("kind", "key", "month")  # fewer than HOT_SHARE rows by definition
    salts = 64
    marked = refs.join(F.broadcast(hot.withColumn("hot", F.lit(True))), ["kind", "key", "month"], "left")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("record_id", "ref_key"), F.lit(salts))).otherwise(0).cast("int")
    spread = suspects.join(F.broadcast(hot.withColumn("hot", F.lit(True))), ["kind", "key", "month"], "left").withColumn(
        "salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    )
    pairs = marked.withColumn("salt", salt).drop("hot").join(spread.drop("hot", "n"), ["kind", "key", "month", "salt"])
    reason = F.when(F.col("known").isNull(), "missing").when(F.col("deleted_at") <= F.col("at"), "deleted").when(F.col("arrived_at") > F.col("at"), "late")
    return pairs.select("source_table", "record_id", "ref_key", "at", reason.alias("reason")).where("reason is not null").distinct()


def audit_references(link: DataFrame, spec: DataFrame, citation: DataFrame, document: DataFrame, clause: DataFrame, pack: DataFrame, item: DataFrame) -> DataFrame:
    """The references of rule links, clause specs and citations held against the tables they name."""
    last = spec.groupBy("corpus_document_id", "label").agg(F.max(F.struct("declared_at", "references_to", "deleted_at")).alias("s"), F.min("declared_at").alias("first"))
    spec_id = F.concat("corpus_document_id", F.lit("#"), "label")
    no_time = F.lit(None).cast("timestamp_ntz")
    names = {"policy_clause": "clause", "rule_version": "rule", "document": "document", "item_entry": "item"}
    kind = F.coalesce(*[F.when(F.col("ref_type") == k, v) for k, v in names.items()])
    refs = (
        link.select(F.lit("rule_link").alias("source_table"), F.col("link_id").cast("string").alias("record_id"), F.col("source_ref.clause_id").alias("ref_key"), F.lit("spec").alias("kind"), plain_key(F.col("source_ref.clause_id")).alias("key"), F.col("linked_at").alias("at"))
        .unionByName(
            last.select(F.lit("clause_spec").alias("source_table"), spec_id.alias("record_id"), F.explode("s.references_to").alias("ref_key"), F.lit("instrument").alias("kind"), F.col("s.declared_at").alias("at")).withColumn("key", alnum_key(F.col("ref_key")))
        )
        .unionByName(citation.select(F.lit("citation").alias("source_table"), F.col("citation_id").cast("string").alias("record_id"), F.col("ref_id").alias("ref_key"), kind.alias("kind"), plain_key(F.col("ref_id")).alias("key"), F.col("cited_at").alias("at")))
        .where("kind is not null")
    )
    parents = (
        last.select(F.lit("spec").alias("kind"), plain_key(spec_id).alias("key"), F.col("first").alias("arrived_at"), F.col("s.deleted_at").alias("deleted_at"))
        .unionByName(document.select(F.lit("instrument").alias("kind"), alnum_key(F.col("reference")).alias("key"), F.col("ingested_at").alias("arrived_at"), "deleted_at"))
        .unionByName(document.select(F.lit("document").alias("kind"), plain_key(F.col("corpus_document_id")).alias("key"), F.col("ingested_at").alias("arrived_at"), "deleted_at"))
        .unionByName(clause.select(F.lit("clause").alias("kind"), plain_key(F.col("clause_id")).alias("key"), F.col("ingested_at").alias("arrived_at"), "deleted_at"))
        .unionByName(pack.select(F.lit("rule").alias("kind"), plain_key(F.col("rule_id")).alias("key"), no_time.alias("arrived_at"), no_time.alias("deleted_at")))
        .unionByName(item.select(F.lit("item").alias("kind"), plain_key(F.col("item_id")).alias("key"), no_time.alias("arrived_at"), no_time.alias("deleted_at")))
    )
    return orphans(refs, parents)
