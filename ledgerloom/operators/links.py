"""Links of rules to the clauses they cite, and checks of applied heads against defined and barred ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import alnum
from ledgerloom.operators.skew import salted_join


def link_rules(links: DataFrame, specs: DataFrame, documents: DataFrame) -> DataFrame:
    """Each distinct link with linked, resolved, agrees, verified, problems and ok.

    links: link_id, rule_id, rule_version, rule_status, effect, instrument_ref, quote, assertable, source_ref (corpus_document_id, clause_id); specs:
    corpus_document_id, label, anchor; documents: corpus_document_id, reference. linked: both halves of the source are there. resolved: its document and clause exist. agrees: the
    instrument's letters and digits contain the document's reference or are contained in it. verified: quote and anchor contain one another, null without a
    quote or clause. Several rows of one clause or document give its smallest anchor and greatest reference. A document or clause that very many links name is salted."""
    l = links.select("link_id", "rule_id", "rule_version", "rule_status", "effect", "instrument_ref", "quote", "assertable", F.col("source_ref.corpus_document_id").alias("doc"), F.lower(F.trim("source_ref.clause_id")).alias("ref")).distinct()
    d = documents.where("corpus_document_id is not null").groupBy(F.col("corpus_document_id").alias("doc")).agg(F.max(alnum(F.col("reference"))).alias("b"), F.lit(True).alias("has_doc"))
    s = specs.where("corpus_document_id is not null and label is not null").groupBy(F.lower(F.trim(F.concat_ws("#", "corpus_document_id", "label"))).alias("ref")).agg(F.min("corpus_document_id").alias("owner"), F.min("anchor").alias("anchor"), F.lit(True).alias("has_clause"))

    def left(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
        lost = rows.join(other.select(key), key, "left_anti")
        return salted_join(rows, other, key).unionByName(lost, allowMissingColumns=True)

    k = left(left(l, d, "doc"), s, "ref")
    yes = lambda c: F.coalesce(c, F.lit(False))
    a, b, quote = alnum(F.col("instrument_ref")), F.col("b"), F.trim(F.coalesce("quote", F.lit("")))
    k = k.withColumns({"linked": F.col("doc").isNotNull() & F.col("ref").isNotNull(), "has_doc": yes(F.col("has_doc")), "has_clause": yes(F.col("has_clause")), "elsewhere": yes(F.col("owner") != F.col("doc"))})
    k = k.withColumns({
        "resolved": F.col("linked") & F.col("has_doc") & F.col("has_clause"),
        "agrees": F.col("has_doc") & yes((b != "") & (b.contains(a) | a.contains(b))),
        "verified": F.when(F.col("has_clause") & (quote != ""), yes(F.col("quote").contains(F.col("anchor")) | F.col("anchor").contains(F.col("quote")))),
    })
    linked = F.col("linked")
    problems = F.concat_ws(
        "; ",
        F.when(~linked, "no source declared"),
        F.when(linked & ~F.col("has_doc"), "document missing"),
        F.when(linked & ~F.col("has_clause"), "clause missing"),
        F.when(linked & F.col("has_doc") & F.col("has_clause") & F.col("elsewhere"), "clause of another document"),
        F.when(~F.col("verified"), "quote not in the clause"),
        F.when(F.col("has_clause") & (quote == "") & (F.col("rule_status") == "verified"), "quote required"),
    )
    k = k.withColumn("problems", problems)
    return k.withColumn("ok", F.col("resolved") & F.col("agrees") & F.coalesce("verified", F.lit(True)) & (F.col("problems") == ""))


def scope_check(rows: DataFrame, applied: str, defined: str, barred: Column) -> DataFrame:
    """rows with outside, barred, allowed and reasons (head:reason+reason), each in the order of `applied`. Nothing is outside an empty definition; its reason says so."""
    has = lambda a, x: F.array_contains(a, x)
    none = F.size(defined) == 0
    why = lambda x: F.concat_ws("+", F.when(has(barred, x), F.when(x == "icu", "ICU_BARRED").otherwise("EXCLUDED")), F.when(none, "NOTHING_DEFINED").when(~has(F.col(defined), x), "NOT_DEFINED"))
    return rows.withColumns({
        "outside": F.filter(applied, lambda x: ~none & ~has(F.col(defined), x)),
        "barred": F.filter(applied, lambda x: has(barred, x)),
        "allowed": F.filter(applied, lambda x: (none | has(F.col(defined), x)) & ~has(barred, x)),
        "reasons": F.transform(applied, lambda x: F.concat_ws(":", x, why(x))),
    })
