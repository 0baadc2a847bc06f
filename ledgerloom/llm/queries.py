"""Queries of the llm subpackage and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import oracles
from ledgerloom.llm.bpe import encode_documents
from ledgerloom.llm.canonical import canonical_texts, quotes_only_alike
from ledgerloom.llm.mixing import draw, mix_marginals, mix_report
from ledgerloom.llm.neardup import CLAUSE_TEXT, TITLE, WEIGHTED, all_field_pairs, all_pairs, field_groups
from ledgerloom.llm.quality import STATISTICS, scored, statistics
from ledgerloom.llm.scans import line_faults, repaired_texts
from ledgerloom.llm.spans import shared_spans, sharing_records, sharing_report
from ledgerloom.session import table


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    cites = table(spark, sf, "citation").where("ref_type = 'policy_clause'")
    return quotes_only_alike(cites, table(spark, sf, "policy_clause"))


def p3_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """Every quote and clause text in its one form."""
    a = table(spark, sf, "citation").select(F.lit("citation").alias("source_table"), F.col("citation_id").cast("string").alias("record_id"), F.col("quote").alias("t"))
    b = table(spark, sf, "policy_clause").select(F.lit("policy_clause").alias("source_table"), F.col("clause_id").alias("record_id"), F.col("original_text").alias("t"))
    return canonical_texts(a.unionByName(b), "t").select("source_table", "record_id", "canonical").distinct()


def _alike_fields(spark: SparkSession, sf: str):
    clause = table(spark, sf, "policy_clause").select(F.col("clause_id").alias("id"), F.col("original_text").alias("text"))
    title = table(spark, sf, "corpus_document").select(F.col("corpus_document_id").alias("id"), F.col("title").alias("text"))
    docs = clause.select(F.lit("clause_text").alias("field"), "*").unionByName(title.select(F.lit("title").alias("field"), "*"))
    return docs, {"clause_text": CLAUSE_TEXT, "title": TITLE}


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return all_field_pairs(*_alike_fields(spark, sf))


def p4_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Every clause and document with words: its group, and the number of different texts its own is alike to."""
    return field_groups(*_alike_fields(spark, sf))


def p4_multiset(spark: SparkSession, sf: str) -> DataFrame:
    """Clauses whose runs of five words, each as often as it occurs, overlap by 0.8 or more."""
    return all_pairs(table(spark, sf, "policy_clause").select(F.col("clause_id").alias("id"), F.col("original_text").alias("text")), WEIGHTED)


def _scans(spark: SparkSession, sf: str):
    pages = table(spark, sf, "page_read").select(F.col("page_read_id").cast("string").alias("record_id"), "document_id", "page_number", F.col("layout.text").alias("text"))
    clauses = table(spark, sf, "policy_clause").select(F.col("clause_id").alias("record_id"), "document_id", F.col("original_text").alias("text"))
    return pages, clauses, table(spark, sf, "corpus_document").select("corpus_document_id", "title", "issuer")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return line_faults(*_scans(spark, sf))


def p5_repaired(spark: SparkSession, sf: str) -> DataFrame:
    """The texts as continuous paragraphs."""
    return repaired_texts(*_scans(spark, sf))


def _passages(spark: SparkSession, sf: str) -> DataFrame:
    of = lambda name, key, text: table(spark, sf, name).select(F.lit(name).alias("source_table"), F.col(key).cast("string").alias("record_id"), F.col(text).alias("text"))
    return of("policy_clause", "clause_id", "original_text").unionByName(of("citation", "citation_id", "quote")).unionByName(of("rule_outcome", "outcome_id", "quote"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return sharing_records(_passages(spark, sf))


def p6_spans(spark: SparkSession, sf: str) -> DataFrame:
    return shared_spans(_passages(spark, sf))


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    return sharing_report(_passages(spark, sf))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_documents(table(spark, sf, "documents"))


def p9_report(spark: SparkSession, sf: str) -> DataFrame:
    return mix_report(table(spark, sf, "documents"), table(spark, sf, "mix_target"))


def p9_draw(spark: SparkSession, sf: str) -> DataFrame:
    """How often each document of the listed sources is used."""
    return draw(table(spark, sf, "documents"), table(spark, sf, "mix_target"))[0].select("doc_id", "source", "tokens", "uses")


def p9_marginals(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of sources, languages and topics before and after."""
    return mix_marginals(table(spark, sf, "documents"), table(spark, sf, "mix_target"))


def p10_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = statistics(table(spark, sf, "documents"))
    return stats.select("doc_id", "language", "words", *[F.round(s, 6).alias(s) for s in STATISTICS if s != "words"])


def p10_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Robust z-scores and percentiles of all statistics, and whether the document is prose."""
    return scored(statistics(table(spark, sf, "documents")))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return scored(statistics(table(spark, sf, "documents"))).where("words > 0 and not prose").select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p3_found, p3_canonical, p4_found, p4_groups, p4_multiset, p5_found, p5_repaired, p6_found, p6_spans, p6_report, p8_ids, p9_report, p9_draw, p9_marginals, p10_found, p10_stats, p10_scores)}
ORACLE: dict[str, str] = dict(oracles.ORACLE)
