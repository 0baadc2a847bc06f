"""Queries over the domain tables, one for each of the engine's operators that SQL can check. Names begin with the operator's id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import money, text as tx
from ledgerloom.operators.components import components
from ledgerloom.operators.predicates import truth_table
from ledgerloom.operators.records import agreement, apportion, cursor_column, index_quantiles, keyset_page, latest, registry, set_hash, text_lines
from ledgerloom.operators.skew import salted_join
from ledgerloom.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _clauses(spark: SparkSession, sf: str) -> DataFrame:
    """policy_clause without repeated rows."""
    return table(spark, sf, "policy_clause").dropDuplicates(["clause_id"])


_C = "c AS (SELECT DISTINCT ON (clause_id) * FROM policy_clause)"


# ---------------------------------------------------------------- sources


@query(f"WITH {_C}, l AS (SELECT clause_id, unnest(string_split(original_text, chr(10))) AS line, generate_subscripts(string_split(original_text, chr(10)), 1) AS line_no FROM c WHERE original_text IS NOT NULL), s AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY clause_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start FROM l) SELECT clause_id, line_no, char_start, char_start + length(line) AS char_end, line FROM s")
def src06_text_lines(spark, sf):
    return text_lines(table(spark, sf, "policy_clause"), "clause_id", "original_text")


@query(f"WITH {_C} SELECT clause_id, sha256(original_text) AS text_hash FROM c WHERE original_text IS NOT NULL")
def src07_page_text(spark, sf):
    """Lines put together again give the text they were cut from."""
    lines = text_lines(table(spark, sf, "policy_clause"), "clause_id", "original_text")
    whole = lines.groupBy("clause_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("x"))  # the lines of one text
    return whole.select("clause_id", F.sha2(F.array_join("x.line", "\n"), 256).alias("text_hash"))


@query("WITH l AS (SELECT DISTINCT link_id, lower(trim(instrument_ref)) AS k FROM rule_link), d AS (SELECT DISTINCT corpus_document_id, lower(trim(reference)) AS k FROM corpus_document WHERE trim(reference) <> '') SELECT link_id, corpus_document_id FROM l JOIN d USING (k)")
def src13_by_reference(spark, sf):
    key = lambda c: F.lower(F.trim(c))
    links = table(spark, sf, "rule_link").select("link_id", key(F.col("instrument_ref")).alias("k")).distinct()
    docs = table(spark, sf, "corpus_document").select("corpus_document_id", key(F.col("reference")).alias("k")).where("k <> ''").distinct()
    return links.join(docs, "k").select("link_id", "corpus_document_id")


@query(r"SELECT source, doc_count FROM (SELECT regexp_replace(lower(regexp_replace(source, '^[\s_]+|[\s_]+$', '', 'g')), '[\s_]+', '_', 'g') AS source, count(*) AS doc_count FROM documents GROUP BY 1)")
def src17_source_names(spark, sf):
    name = F.regexp_replace(F.lower(F.regexp_replace("source", r"^[\s_]+|[\s_]+$", "")), r"[\s_]+", "_")
    return table(spark, sf, "documents").groupBy(name.alias("source")).agg(F.count(F.lit(1)).alias("doc_count"))


@query("SELECT sha256(text) AS content_id, min(doc_id) AS first_id, count(*) AS copies, max(length(text)) AS chars FROM documents WHERE text IS NOT NULL GROUP BY 1")
def src18_registry(spark, sf):
    return registry(table(spark, sf, "documents"), "doc_id", "text")


@query("""SELECT rule_id || '#' || rule_version AS record_id, '{"rule_id":"' || rule_id || '","version":' || rule_version || ',"kind":"' || kind || '","status":"' || rule_status || '"}' AS report FROM (SELECT DISTINCT rule_id, rule_version, kind, rule_status FROM rule_pack)""")
def src19_report_rows(spark, sf):
    r = table(spark, sf, "rule_pack").select("rule_id", "rule_version", "kind", "rule_status").distinct()
    return r.select(F.concat_ws("#", "rule_id", "rule_version").alias("record_id"), F.to_json(F.struct("rule_id", F.col("rule_version").alias("version"), "kind", F.col("rule_status").alias("status"))).alias("report"))


# ---------------------------------------------------------------- predicates

_PREDICATES = {
    "verified": {"fact": {"id": "verified", "op": "eq", "value": True}},
    "clause_on_late_page": {"all": [{"fact": {"id": "ref_type", "op": "eq", "value": "policy_clause"}}, {"fact": {"id": "page_number", "op": "gt", "value": 4}}]},
    "no_page_or_unverified": {"any": [{"not": {"fact": {"id": "page_number", "op": "present"}}}, {"fact": {"id": "verified", "op": "eq", "value": False}}]},
    "page_not_two": {"not": {"fact": {"id": "page_number", "op": "eq", "value": 2}}},
    "known_kinds": {"fact": {"id": "ref_type", "op": "in", "value": ["document", "item_entry"]}},
    "mentions_rupees": {"fact": {"id": "quote", "op": "contains", "value": "Rs "}},
    "kinds_differ": {"fact": {"id": "quote", "op": "gt", "value": 3}},
    "nothing": {"any": []},
    "open": {"all": [{"const": None}, {"fact": {"id": "verified", "op": "present"}}]},
}
_TRUTHS = {
    "verified": "verified = TRUE",
    "clause_on_late_page": "ref_type = 'policy_clause' AND page_number > 4",
    "no_page_or_unverified": "page_number IS NULL OR verified = FALSE",
    "page_not_two": "NOT page_number = 2",
    "known_kinds": "coalesce(ref_type IN ('document', 'item_entry'), FALSE)",
    "mentions_rupees": "coalesce(contains(quote, 'Rs '), FALSE)",
    "kinds_differ": "NULL::BOOLEAN",
    "nothing": "FALSE",
    "open": "NULL::BOOLEAN AND verified IS NOT NULL",
}


@query("SELECT predicate, truth, count(*) AS rows FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS predicate, CASE WHEN {s} THEN 'TRUE' WHEN NOT ({s}) THEN 'FALSE' ELSE 'UNKNOWN' END AS truth FROM citation" for n, s in _TRUTHS.items()) + ") GROUP BY 1, 2")
def prd05_predicates(spark, sf):
    return truth_table(table(spark, sf, "citation"), _PREDICATES)


@query("SELECT citation_id, CASE WHEN quote IS NOT NULL THEN CASE WHEN verified THEN quote END ELSE title END AS value FROM (SELECT DISTINCT citation_id, quote, verified, title FROM citation)")
def prd12_masked_lookup(spark, sf):
    """A stored fact that can't be used hides the named value instead of falling back to it."""
    c = table(spark, sf, "citation").select("citation_id", "quote", "verified", "title").distinct()
    return c.select("citation_id", F.when(F.col("quote").isNotNull(), F.when(F.col("verified"), F.col("quote"))).otherwise(F.col("title")).alias("value"))


@query("SELECT head, count(*) AS outcomes FROM rule_outcome WHERE starts_with(rule_id, 'RULE-PD') AND outcome IS NOT NULL GROUP BY 1")
def prd14_prefix_filter(spark, sf):
    return table(spark, sf, "rule_outcome").where(F.col("rule_id").startswith("RULE-PD") & F.col("outcome").isNotNull()).groupBy("head").agg(F.count(F.lit(1)).alias("outcomes"))


#: Texts with identifiers of every kind, as the documents have few; their ids are negative.
PLANTED = (
    "PAN ABCDE1234F and mobile 9876543210", "Aadhaar 2345 6789 0123 of the father", 'hash 234567890123\n"196573435217",\nnumber 234567890123', "GSTIN 27ABCDE1234F1Z5, mail a.b@example.org",
    "UHID: AB12345 Rs 1000000 INR 500000 INT2043376 MPF252125 AB 123456 AB-123456", "company and discrepancy only", "email us, phone later; REG NO 12345 K1234567 ABC1234567", "",
)
_DOCS = "docs AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-k}, '{t}')" for k, t in enumerate(PLANTED, 1)) + ") v(doc_id, text))"


def with_planted(spark, sf) -> DataFrame:
    """doc_id, text of the documents and of the planted texts."""
    return table(spark, sf, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(-k, t) for k, t in enumerate(PLANTED, 1)], "doc_id bigint, text string"))


_REDACT = "text"
for _k, _p in tx.IDENTIFIERS.items():
    _REDACT = f"regexp_replace({_REDACT}, '{_p}', '<{_k}>', 'g')"


@query(rf"WITH {_DOCS} SELECT doc_id, sha256(regexp_replace({_REDACT}, '\d', '•', 'g')) AS redacted_hash FROM docs WHERE text IS NOT NULL")
def prd15_redacted(spark, sf):
    """Allowed columns only, texts without identifiers and digits; hashed here to keep the result small."""
    return with_planted(spark, sf).where("text is not null").select("doc_id", F.sha2(tx.redacted(F.col("text")), 256).alias("redacted_hash"))


@query("SELECT CASE WHEN q >= 0.8 THEN 'ADEQUATE' WHEN q >= 0.5 THEN 'LOW' WHEN q IS NULL THEN 'UNKNOWN' ELSE 'CRITICAL' END AS tier, count(*) AS pages FROM (SELECT layout.mean_confidence AS q FROM page_read) GROUP BY 1")
def prd20_quality_tiers(spark, sf):
    q = F.col("layout.mean_confidence")
    return table(spark, sf, "page_read").groupBy(F.when(q >= 0.8, "ADEQUATE").when(q >= 0.5, "LOW").when(q.isNull(), "UNKNOWN").otherwise("CRITICAL").alias("tier")).agg(F.count(F.lit(1)).alias("pages"))


# ---------------------------------------------------------------- joins


@query("WITH p AS (SELECT DISTINCT document_id, page_number FROM page_read), c AS (SELECT DISTINCT citation_id, document_id, page_number FROM citation) SELECT document_id, page_number, count(*) AS citations FROM c JOIN p USING (document_id, page_number) GROUP BY 1, 2")
def jon01_page_citations(spark, sf):
    keys = ["document_id", "page_number"]
    c = table(spark, sf, "citation").select("citation_id", *keys).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("citations"))
    return c.join(table(spark, sf, "page_read").select(*keys).distinct(), keys)


_ITEM_KEY = r"trim(regexp_replace(regexp_replace(lower({}), '\([^)]*\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"


@query(f"WITH n AS (SELECT DISTINCT item_id, {_ITEM_KEY.format('name')} AS k FROM (SELECT item_id, item_name AS name FROM nonpayable_item UNION ALL SELECT item_id, unnest(aliases) FROM nonpayable_item)), t AS (SELECT DISTINCT title, {_ITEM_KEY.format('title')} AS k FROM citation WHERE title IS NOT NULL) SELECT DISTINCT t.title, n.item_id FROM t JOIN n ON n.k <> '' AND contains(' ' || t.k || ' ', ' ' || n.k || ' ')")
def jon04_item_match(spark, sf):
    """Names in titles as whole words: every run of words of a title meets the names by equality, so nothing is compared pair by pair."""
    items = table(spark, sf, "nonpayable_item")
    names = items.select("item_id", F.explode(F.concat(F.array("item_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n")).select("item_id", tx.item_key(F.col("n")).alias("k")).where("k <> ''").distinct()
    longest = names.agg(F.max(F.size(F.split("k", " ")))).first()[0] or 0
    titles = table(spark, sf, "citation").where("title is not null").select("title").distinct().withColumn("w", F.split(tx.item_key(F.col("title")), " "))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("w"))), lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))
    return titles.where("size(w) > 0").select("title", F.explode(F.array_distinct(runs)).alias("k")).join(names, "k").select("title", "item_id").distinct()


@query("""WITH s AS (SELECT corpus_document_id, label, max(page_number) AS page FROM clause_spec GROUP BY 1, 2), d AS (SELECT DISTINCT corpus_document_id AS doc FROM corpus_document),
 k AS (SELECT DISTINCT link_id, source_ref.corpus_document_id AS doc, lower(trim(source_ref.clause_id)) AS ref, source_ref.page_number AS page FROM rule_link)
 SELECT k.link_id, concat_ws('; ', CASE WHEN k.doc IS NULL OR k.ref IS NULL THEN 'no source' END, CASE WHEN k.doc IS NOT NULL AND d.doc IS NULL THEN 'document missing' END, CASE WHEN k.ref IS NOT NULL AND s.label IS NULL THEN 'clause missing' END, CASE WHEN s.page <> k.page THEN 'page differs' END) AS problems
 FROM k LEFT JOIN d ON k.doc = d.doc LEFT JOIN s ON lower(trim(s.corpus_document_id || '#' || s.label)) = k.ref""")
def jon05_link_problems(spark, sf):
    spec = table(spark, sf, "clause_spec").groupBy("corpus_document_id", "label").agg(F.max("page_number").alias("spec_page")).select(F.lower(F.trim(F.concat_ws("#", "corpus_document_id", "label"))).alias("ref"), "label", "spec_page")
    docs = table(spark, sf, "corpus_document").select(F.col("corpus_document_id").alias("doc"), F.lit(True).alias("there")).distinct()
    link = table(spark, sf, "rule_link").select("link_id", F.col("source_ref.corpus_document_id").alias("doc"), F.lower(F.trim("source_ref.clause_id")).alias("ref"), F.col("source_ref.page_number").alias("page")).distinct()
    j = link.join(docs, "doc", "left").join(spec, "ref", "left")
    problems = F.concat_ws(
        "; ",
        F.when(F.col("doc").isNull() | F.col("ref").isNull(), "no source"),
        F.when(F.col("doc").isNotNull() & F.col("there").isNull(), "document missing"),
        F.when(F.col("ref").isNotNull() & F.col("label").isNull(), "clause missing"),
        F.when(F.col("spec_page") != F.col("page"), "page differs"),
    )
    return j.select("link_id", problems.alias("problems"))


_ALNUM = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"


@query(f"WITH l AS (SELECT DISTINCT link_id, source_ref.corpus_document_id AS doc, {_ALNUM.format('instrument_ref')} AS a FROM rule_link), d AS (SELECT corpus_document_id AS doc, max({_ALNUM.format('reference')}) AS b FROM corpus_document GROUP BY 1) SELECT link_id, coalesce(a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a)), FALSE) AS agrees FROM l LEFT JOIN d USING (doc)")
def jon06_instrument_agrees(spark, sf):
    links = table(spark, sf, "rule_link").select("link_id", F.col("source_ref.corpus_document_id").alias("doc"), tx.alnum(F.col("instrument_ref")).alias("a")).distinct()
    docs = table(spark, sf, "corpus_document").groupBy(F.col("corpus_document_id").alias("doc")).agg(F.max(tx.alnum(F.col("reference"))).alias("b"))
    a, b = F.col("a"), F.col("b")
    return links.join(docs, "doc", "left").select("link_id", F.coalesce((a != "") & (b != "") & (a.contains(b) | b.contains(a)), F.lit(False)).alias("agrees"))


@query("SELECT finding_id, max_by(citation_id, (loaded_at, citation_id)) AS last_citation FROM citation WHERE finding_id IS NOT NULL GROUP BY 1")
def jon08_last_wins(spark, sf):
    return table(spark, sf, "citation").where("finding_id is not null").groupBy("finding_id").agg(F.max_by("citation_id", F.struct("loaded_at", "citation_id")).alias("last_citation"))


@query("SELECT DISTINCT rule_id, rule_version FROM rule_pack p WHERE EXISTS (SELECT 1 FROM rule_outcome o WHERE o.rule_id = p.rule_id AND o.rule_version = p.rule_version)")
def jon11_rules_with_outcomes(spark, sf):
    k = ["rule_id", "rule_version"]
    return table(spark, sf, "rule_pack").select(*k).distinct().join(table(spark, sf, "rule_outcome").select(*k).distinct(), k, "left_semi")


@query("SELECT DISTINCT rule_id, rule_version FROM rule_pack p WHERE NOT EXISTS (SELECT 1 FROM rule_link o WHERE o.rule_id = p.rule_id AND o.rule_version = p.rule_version)")
def jon12_rules_without_links(spark, sf):
    k = ["rule_id", "rule_version"]
    return table(spark, sf, "rule_pack").select(*k).distinct().join(table(spark, sf, "rule_link").select(*k).distinct(), k, "left_anti")


# ---------------------------------------------------------------- aggregations


@query("SELECT l_orderkey, l_returnflag AS head, sum(cast(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS paise FROM lineitem GROUP BY 1, 2")
def agg03_head_totals(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("head")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("paise"))


@query("SELECT coalesce(rule_status, '(all)') AS rule_status, count(*) AS rules FROM (SELECT DISTINCT rule_id, rule_version, rule_status FROM rule_pack) GROUP BY ROLLUP (rule_status)")
def agg11_pack_summary(spark, sf):
    return table(spark, sf, "rule_pack").select("rule_id", "rule_version", "rule_status").distinct().rollup("rule_status").agg(F.count(F.lit(1)).alias("rules")).withColumn("rule_status", F.coalesce("rule_status", F.lit("(all)")))


@query("SELECT count(*) AS links, count_if(assertable) AS assertable, count_if(source_ref IS NULL) AS unlinked, count_if(len(problems) > 0) AS with_problems, count_if(list_contains(problems, 'quote not found')) AS quote_missing, count_if(list_contains(problems, 'instrument differs')) AS instrument_differs, count(DISTINCT rule_id) AS rules FROM (SELECT DISTINCT * FROM rule_link)")
def agg12_link_summary(spark, sf):
    r = table(spark, sf, "rule_link").distinct()
    has = lambda p: F.count_if(F.array_contains("problems", p))
    return r.agg(F.count(F.lit(1)).alias("links"), F.count_if("assertable").alias("assertable"), F.count_if(F.col("source_ref").isNull()).alias("unlinked"), F.count_if(F.size("problems") > 0).alias("with_problems"), has("quote not found").alias("quote_missing"), has("instrument differs").alias("instrument_differs"), F.countDistinct("rule_id").alias("rules"))


@query(f"WITH {_C}, s AS (SELECT document_id, list(length(original_text) ORDER BY length(original_text)) AS v FROM c WHERE original_text IS NOT NULL GROUP BY 1) SELECT document_id, len(v) AS n, v[1] AS shortest, v[least(len(v) // 2, len(v) - 1) + 1] AS median, v[least(floor(0.9 * len(v))::INT, len(v) - 1) + 1] AS p90, v[len(v)] AS longest FROM s")
def agg14_clause_quantiles(spark, sf):
    rows = _clauses(spark, sf).select("document_id", F.length("original_text").cast("bigint").alias("len"))
    return index_quantiles(rows, ["document_id"], "len", {"shortest": 0.0, "median": 0.5, "p90": 0.9, "longest": 1.0})


@query("SELECT count(*) AS documents, count(DISTINCT sha256(text)) AS contents, count_if(text IS NULL) AS without_text, sum(n_chars)::BIGINT AS chars, count(DISTINCT issuer) AS issuers FROM documents")
def agg15_registry_totals(spark, sf):
    return table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("documents"), F.countDistinct(F.sha2("text", 256)).alias("contents"), F.count_if(F.col("text").isNull()).alias("without_text"), F.sum("n_chars").alias("chars"), F.countDistinct("issuer").alias("issuers"))


@query(f"WITH {_C}, g AS (SELECT uin, count(DISTINCT document_id) AS documents, count(*) AS clauses FROM c WHERE uin IS NOT NULL GROUP BY 1) SELECT uin, documents, clauses FROM g WHERE documents > 1")
def agg16_shared_identifiers(spark, sf):
    return _clauses(spark, sf).where("uin is not null").groupBy("uin").agg(F.countDistinct("document_id").alias("documents"), F.count(F.lit(1)).alias("clauses")).where("documents > 1")


@query(f"""WITH RECURSIVE {_C}, e AS (SELECT DISTINCT document_id AS d, product AS p FROM c WHERE document_id IS NOT NULL AND product IS NOT NULL),
 n AS (SELECT DISTINCT a.d AS x, b.d AS y FROM e a JOIN e b USING (p)), r AS (SELECT x, y FROM n UNION SELECT r.x, n.y FROM r JOIN n ON r.y = n.x) SELECT x AS document_id, min(y) AS family FROM r GROUP BY 1""")
def agg17_families(spark, sf):
    """Documents connected by products they share, through any number of others."""
    e = _clauses(spark, sf).where("document_id is not null and product is not null").select(F.concat(F.lit("d:"), "document_id").alias("a"), F.concat(F.lit("p:"), "product").alias("b")).distinct()
    comp = components(e)
    return comp.where("node like 'd:%'").select(F.expr("substring(node, 3)").alias("document_id"), F.expr("substring(component, 3)").alias("family"))


@query(f"WITH {_C} SELECT coalesce(heading_label, '') AS label, count(*) AS clauses FROM c GROUP BY 1 HAVING count(*) > 1 ORDER BY clauses DESC, label LIMIT 10")
def agg18_collisions(spark, sf):
    """The ten labels that most clauses would share if labels were identities."""
    return _clauses(spark, sf).groupBy(F.coalesce("heading_label", F.lit("")).alias("label")).agg(F.count(F.lit(1)).alias("clauses")).where("clauses > 1").orderBy(F.desc("clauses"), "label").limit(10)


_NUMBERS = r"array_to_string(list_sort(list_filter(list_transform(regexp_extract_all({}, '\d[\d,\. ]*\d|\d'), lambda x: regexp_replace(regexp_replace(x, '[,\s]', '', 'g'), '^\.+|\.+$', '', 'g')), lambda x: x <> '')), ' ')"


@query(f"SELECT DISTINCT citation_id, {_NUMBERS.format('quote')} AS numbers FROM citation WHERE quote IS NOT NULL")
def agg21_number_signature(spark, sf):
    return table(spark, sf, "citation").where("quote is not null").select("citation_id", F.array_join(tx.numeric_signature(F.col("quote")), " ").alias("numbers")).distinct()


@query("SELECT DISTINCT citation_id, array_to_string(list_sort(list_filter(regexp_extract_all(lower(quote), '[a-z]+'), lambda w: list_contains(" + str(tx.NEGATIONS + tx.MODALS) + ", w))), ' ') AS words FROM citation WHERE quote IS NOT NULL")
def agg22_word_signature(spark, sf):
    return table(spark, sf, "citation").where("quote is not null").select("citation_id", F.array_join(tx.bearing_signature(F.col("quote")), " ").alias("words")).distinct()


@query("WITH d AS (SELECT DISTINCT document_id, sha256(original_text) AS h FROM policy_clause WHERE original_text IS NOT NULL) SELECT document_id, sha256(string_agg(h, ',' ORDER BY h)) AS set_hash, count(*) AS members FROM d GROUP BY 1")
def agg24_clause_set_hash(spark, sf):
    return set_hash(table(spark, sf, "policy_clause"), "document_id", "original_text")


@query("SELECT document_id, round(avg(layout.mean_confidence), 4) AS mean_confidence, count(layout.mean_confidence) AS pages FROM page_read GROUP BY 1 HAVING count(layout.mean_confidence) > 0")
def agg26_confidence(spark, sf):
    c = F.col("layout.mean_confidence")
    return table(spark, sf, "page_read").groupBy("document_id").agg(F.round(F.avg(c), 4).alias("mean_confidence"), F.count(c).alias("pages")).where("pages > 0")


@query("SELECT document_id, median(layout.mean_confidence) AS median_confidence FROM page_read GROUP BY 1")
def sec34_median(spark, sf):
    return table(spark, sf, "page_read").groupBy("document_id").agg(F.median("layout.mean_confidence").alias("median_confidence"))


# ---------------------------------------------------------------- windows and order


@query("SELECT case_id, rule_id, outcome_id, outcome FROM (SELECT case_id, rule_id, outcome_id, outcome, row_number() OVER (PARTITION BY case_id, rule_id ORDER BY loaded_at DESC, outcome_id DESC) AS n FROM rule_outcome WHERE case_id IS NOT NULL AND rule_id IS NOT NULL) WHERE n = 1")
def win01_latest_outcome(spark, sf):
    return latest(table(spark, sf, "rule_outcome").where("case_id is not null and rule_id is not null").select("case_id", "rule_id", "loaded_at", "outcome_id", "outcome"), ["case_id", "rule_id"], ["loaded_at", "outcome_id"]).drop("loaded_at")


@query("SELECT finding_id, citation_id, row_number() OVER (PARTITION BY finding_id ORDER BY cited_at, citation_id) AS number FROM (SELECT DISTINCT finding_id, citation_id, cited_at FROM citation)")
def win04_numbering(spark, sf):
    c = table(spark, sf, "citation").select("finding_id", "citation_id", "cited_at").distinct()
    return c.select("finding_id", "citation_id", F.row_number().over(W.partitionBy("finding_id").orderBy("cited_at", "citation_id")).cast("bigint").alias("number"))


@query(f"WITH {_C} SELECT clause_id, document_id, char_start, lead(char_start) OVER (PARTITION BY document_id, page_number ORDER BY char_start, clause_id) AS char_end FROM c")
def win05_slices(spark, sf):
    """A clause reaches to where the next one on its page begins."""
    w = W.partitionBy("document_id", "page_number").orderBy("char_start", "clause_id")
    return _clauses(spark, sf).select("clause_id", "document_id", "char_start", F.lead("char_start").over(w).alias("char_end"))


@query("""WITH e AS (SELECT user_id, event_id, cast(round(value * 100) AS HUGEINT) AS w FROM events WHERE value > 0), a AS (SELECT *, sum(w) OVER (PARTITION BY user_id) AS total FROM e), b AS (SELECT *, (w * 10000) // total AS f, (w * 10000) % total AS r FROM a WHERE total > 0),
 c AS (SELECT *, 10000 - sum(f) OVER (PARTITION BY user_id) AS rest, row_number() OVER (PARTITION BY user_id ORDER BY r DESC, event_id) AS n FROM b) SELECT user_id, event_id, (f + CASE WHEN n <= rest THEN 1 ELSE 0 END)::BIGINT AS share FROM c""")
def win08_apportion(spark, sf):
    rows = table(spark, sf, "events").where("value > 0").select("user_id", "event_id", F.round(F.col("value") * 100).cast("bigint").alias("w")).where("w > 0")
    return apportion(rows, "user_id", "event_id", "w", 10_000)


@query("SELECT citation_id, cited_at FROM (SELECT DISTINCT citation_id, cited_at FROM citation) WHERE (cited_at, citation_id) < (TIMESTAMP '2025-06-01 00:00:00', 1000) ORDER BY cited_at DESC, citation_id DESC LIMIT 26")
def srt01_keyset_page(spark, sf):
    """A page of 25 and one more, which tells that there is a next page."""
    import datetime as dt

    rows = table(spark, sf, "citation").select("citation_id", "cited_at").distinct()
    return keyset_page(rows, ["cited_at", "citation_id"], 26, (dt.datetime(2025, 6, 1), 1000))


@query(r"""SELECT DISTINCT citation_id, regexp_replace(translate(to_base64(encode('["' || ref_type || '","' || citation_id || '"]')), '+/', '-_'), '=+$', '') AS cursor FROM citation""")
def srt02_cursors(spark, sf):
    return table(spark, sf, "citation").select("citation_id", cursor_column(F.col("ref_type"), F.col("citation_id").cast("string")).alias("cursor")).distinct()


@query("SELECT ref_type, min_by(citation_id, (cited_at, citation_id)) AS first_citation FROM citation GROUP BY 1")
def srt09_next(spark, sf):
    return table(spark, sf, "citation").groupBy("ref_type").agg(F.min_by("citation_id", F.struct("cited_at", "citation_id")).alias("first_citation"))


# ---------------------------------------------------------------- sets

_DROP = ("quote not found", "page missing")


@query("SELECT DISTINCT link_id, array_to_string(list_filter(problems, lambda p: p NOT IN ('quote not found', 'page missing')), '; ') AS kept FROM rule_link WHERE problems IS NOT NULL")
def set01_minus(spark, sf):
    """Order and repeats are kept."""
    return table(spark, sf, "rule_link").where("problems is not null").select("link_id", F.array_join(F.filter("problems", lambda p: ~p.isin(*_DROP)), "; ").alias("kept")).distinct()


@query("SELECT DISTINCT outcome_id, array_to_string(list_sort(list_distinct(list_concat(reasons, [kind]))), '; ') AS merged FROM rule_outcome WHERE reasons IS NOT NULL AND kind IS NOT NULL")
def set02_union(spark, sf):
    return table(spark, sf, "rule_outcome").where("reasons is not null and kind is not null").select("outcome_id", F.array_join(F.array_sort(F.array_distinct(F.filter(F.concat("reasons", F.array("kind")), lambda x: x.isNotNull()))), "; ").alias("merged")).distinct()


@query("SELECT 'policy_clause' AS src, document_id AS doc FROM policy_clause WHERE document_id IS NOT NULL UNION SELECT 'page_read', document_id FROM page_read WHERE document_id IS NOT NULL UNION SELECT 'citation', document_id FROM citation WHERE document_id IS NOT NULL UNION SELECT 'clause_spec', corpus_document_id FROM clause_spec WHERE corpus_document_id IS NOT NULL")
def set06_document_keys(spark, sf):
    of = lambda t, c: table(spark, sf, t).where(F.col(c).isNotNull()).select(F.lit(t).alias("src"), F.col(c).alias("doc")).distinct()
    return of("policy_clause", "document_id").union(of("page_read", "document_id")).union(of("citation", "document_id")).union(of("clause_spec", "corpus_document_id"))


# ---------------------------------------------------------------- exact numbers


@query("WITH p AS (SELECT l_orderkey, sum(cast(round(l_extendedprice * 100) AS HUGEINT)) AS a, sum(cast(round(l_quantity) AS HUGEINT)) AS n FROM lineitem GROUP BY 1) SELECT l_orderkey, ((2 * a * n + 700) // (2 * 700))::BIGINT AS share FROM p")
def cal02_half_up(spark, sf):
    p = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("a"), F.sum(F.round("l_quantity").cast("bigint")).alias("n"))
    return p.select("l_orderkey", money.half_up(F.col("a"), F.col("n"), F.lit(700)).alias("share"))


_AMOUNTS = r"(SELECT clause_id, unnest(regexp_extract_all(original_text, '(?i)(?:rs\.?|inr|₹)\s*(\d[\d,]*(?:\.\d+)?)', 1)) AS a FROM c WHERE original_text IS NOT NULL)"
_PAISE = r"cast(replace(regexp_extract(a, '^([\d,]+)', 1), ',', '') AS BIGINT) * 100 + cast(substr(rpad(regexp_extract(a, '\.(\d+)$', 1), 3, '0'), 1, 2) AS BIGINT) + CASE WHEN substr(rpad(regexp_extract(a, '\.(\d+)$', 1), 3, '0'), 3, 1) >= '5' THEN 1 ELSE 0 END"


@query(f"WITH {_C} SELECT clause_id, count(*) AS amounts, sum({_PAISE})::BIGINT AS paise FROM {_AMOUNTS} GROUP BY 1")
def fun01_amounts(spark, sf):
    a = _clauses(spark, sf).where("original_text is not null").select("clause_id", F.explode(F.regexp_extract_all("original_text", F.lit(money.PRICED), F.lit(1))).alias("a"))
    # no sum where one of the amounts is beyond a bigint
    whole = F.every(F.col("p").isNotNull())
    return a.withColumn("p", money.decimal_paise(F.col("a"))).groupBy("clause_id").agg(F.count(F.lit(1)).alias("amounts"), F.when(whole, F.sum("p")).alias("paise"))


@query(rf"WITH {_C}, i AS (SELECT regexp_extract(a, '^([\d,]+)', 1) AS g FROM {_AMOUNTS}) SELECT CASE WHEN NOT contains(g, ',') THEN 'plain' WHEN regexp_full_match(g, '\d{{1,3}},\d{{3}}') THEN 'ambiguous_equal' WHEN regexp_full_match(g, '\d{{1,3}}(,\d{{2}})+,\d{{3}}') THEN 'indian' WHEN regexp_full_match(g, '\d{{1,3}}(,\d{{3}})+') THEN 'western' ELSE 'invalid' END AS style, count(*) AS amounts FROM i GROUP BY 1")
def fun04_grouping(spark, sf):
    a = _clauses(spark, sf).where("original_text is not null").select(F.explode(F.regexp_extract_all("original_text", F.lit(money.PRICED), F.lit(1))).alias("a"))
    return a.groupBy(money.grouping_style(F.regexp_extract("a", r"^([\d,]+)", 1)).alias("style")).agg(F.count(F.lit(1)).alias("amounts"))


@query("WITH t AS (SELECT DISTINCT o_orderkey, translate(cast(o_orderkey * 7919 AS VARCHAR), '0158', 'OlSB') AS token, cast(o_orderkey * 7919 AS VARCHAR) AS number FROM orders), n AS (SELECT *, len(list_distinct(list_filter(string_split(token, ''), lambda x: x IN ('O', 'l', 'S', 'B')))) AS swaps FROM t) SELECT o_orderkey, token, CASE WHEN swaps <= greatest(1, length(token) // 2) AND length(token) > 1 THEN number ELSE token END AS repaired FROM n")
def fun05_digit_repair(spark, sf):
    """Order numbers as a scan might read them, and put right."""
    number = (F.col("o_orderkey") * 7919).cast("string")
    t = table(spark, sf, "orders").select("o_orderkey", F.translate(number, "0158", "OlSB").alias("token")).distinct()
    return t.withColumn("repaired", money.repaired_digits(F.col("token")))


@query("WITH o AS (SELECT o_orderkey, cast(round(o_totalprice * 100) AS BIGINT) AS p FROM orders), r AS (SELECT *, cast(p // 100 AS VARCHAR) AS d FROM o), g AS (SELECT *, CASE WHEN length(d) > 3 THEN substr(d, 1, length(d) - 3) ELSE '' END AS h, right(d, 3) AS t FROM r) SELECT o_orderkey, CASE WHEN h = '' THEN d WHEN length(h) <= 2 THEN h || ',' || t WHEN length(h) <= 4 THEN substr(h, 1, length(h) - 2) || ',' || right(h, 2) || ',' || t ELSE substr(h, 1, length(h) - 4) || ',' || substr(h, length(h) - 3, 2) || ',' || right(h, 2) || ',' || t END || '.' || lpad(cast(p % 100 AS VARCHAR), 2, '0') AS shown FROM g")
def fun10_inr_display(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("p"))
    return o.select("o_orderkey", money.format_inr(F.col("p")).alias("shown"))


@query("SELECT p_partkey, p_size AS n, p_size AS back FROM part")
def fun09_words(spark, sf):
    """Sizes in words and back."""
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("n"), money.from_words(money.in_words(F.col("p_size").cast("bigint"))).cast("int").alias("back"))
    return p


_TOKENS = r"(SELECT doc_id, unnest(regexp_extract_all(text, '\d[\d,]*(?:\.\d{1,2})?|\d[\d.]*,\d{1,2}')) AS t FROM documents WHERE text IS NOT NULL)"
_CLASS = r"CASE WHEN regexp_full_match(t, '\d[\d,]*\.\d{1,2}') THEN CASE WHEN contains(t, ',') AND NOT regexp_full_match(string_split(t, '.')[1], '\d{1,3}(,\d{2,3})+') THEN 'malformed' ELSE 'strict_decimal' END WHEN regexp_full_match(t, '\d{1,3}(,\d{2,3})*,\d{2}') THEN 'decimal_comma' WHEN regexp_full_match(t, '\d{1,3}(,\d{2,3})+') THEN 'grouped_integer' WHEN regexp_full_match(t, '\d+') THEN 'plain_integer' ELSE 'malformed' END"


@query(f"SELECT doc_id, {_CLASS} AS class, count(*) AS tokens FROM {_TOKENS} GROUP BY 1, 2")
def fun18_token_classes(spark, sf):
    t = table(spark, sf, "documents").where("text is not null").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(money.TOKEN), F.lit(0))).alias("t"))
    return t.groupBy("doc_id", money.token_class(F.col("t")).alias("class")).agg(F.count(F.lit(1)).alias("tokens"))


@query(r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL), m AS (SELECT doc_id, line_no, regexp_extract_all(line, '\d[\d,]*\.\d{2}') AS t FROM l) SELECT doc_id, line_no, len(t) AS tokens, cast(replace(replace(t[len(t)], ',', ''), '.', '') AS BIGINT) AS paise FROM m WHERE len(t) > 0")
def fun21_line_amounts(spark, sf):
    """The last amount of two decimals on a line is the line's."""
    lines = table(spark, sf, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    t = lines.select("doc_id", (F.col("pos") + 1).cast("bigint").alias("line_no"), F.regexp_extract_all("line", F.lit(money.STRICT_TOKEN), F.lit(0)).alias("t")).where("size(t) > 0")
    return t.select("doc_id", "line_no", F.size("t").cast("bigint").alias("tokens"), money.decimal_paise(F.element_at("t", -1)).alias("paise"))


@query(r"SELECT doc_id, round(length(regexp_replace(text, '[^0-9]', '', 'g')) / length(text), 6) AS digit_density FROM documents WHERE length(text) > 0")
def fun25_digit_density(spark, sf):
    return table(spark, sf, "documents").where("length(text) > 0").select("doc_id", F.round(F.length(F.regexp_replace("text", "[^0-9]", "")) / F.length("text"), 6).alias("digit_density"))


@query(r"WITH l AS (SELECT page_read_id, unnest(string_split(layout.text, chr(10))) AS line FROM (SELECT DISTINCT ON (page_read_id) * FROM page_read) WHERE layout.text IS NOT NULL), f AS (SELECT page_read_id, len(regexp_extract_all(line, '\d[\d,]*(?:\.\d{1,2})?')) AS n FROM l WHERE trim(line) <> '') SELECT page_read_id, count(*) AS lines, count_if(n >= 2) AS tabular FROM f GROUP BY 1")
def fun28_table_lines(spark, sf):
    p = table(spark, sf, "page_read").dropDuplicates(["page_read_id"]).select("page_read_id", F.explode(F.split("layout.text", "\n")).alias("line")).where("trim(line) <> ''")
    return p.groupBy("page_read_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.regexp_count("line", F.lit(r"\d[\d,]*(?:\.\d{1,2})?")) >= 2).alias("tabular"))


# ---------------------------------------------------------------- text


@query(f"WITH {_C}, q AS (SELECT DISTINCT citation_id, lower(trim(ref_id)) AS k, quote FROM citation WHERE ref_type = 'policy_clause' AND quote <> '') SELECT q.citation_id, (length(c.original_text) - length(replace(c.original_text, q.quote, ''))) // length(q.quote) AS times FROM q JOIN c ON lower(trim(c.clause_id)) = q.k WHERE c.original_text IS NOT NULL")
def txt03_quote_occurrences(spark, sf):
    """How often a quote stands in the clause it cites: once is exact, more is ambiguous, none is for the tolerant tiers."""
    key = lambda c: F.lower(F.trim(c))
    q = table(spark, sf, "citation").where("ref_type = 'policy_clause' and quote <> ''").select("citation_id", key(F.col("ref_id")).alias("k"), "quote").distinct()
    c = _clauses(spark, sf).where("original_text is not null").select(key(F.col("clause_id")).alias("k"), "original_text")
    return salted_join(q, c, "k").select("citation_id", tx.occurrences(F.col("original_text"), F.col("quote")).alias("times"))


@query(f"WITH o AS (SELECT DISTINCT outcome_id, rule_id, rule_version, quote FROM rule_outcome WHERE quote IS NOT NULL), p AS (SELECT DISTINCT rule_id, rule_version, quote AS want FROM rule_pack WHERE quote IS NOT NULL) SELECT outcome_id, {_NUMBERS.format('quote')} = {_NUMBERS.format('want')} AS same_numbers FROM o JOIN p USING (rule_id, rule_version)")
def txt04_number_guard(spark, sf):
    """Whether an outcome's quote prints the numbers of its rule's. One rule may have most outcomes: rules are few, and joined salted."""
    k = F.concat_ws("#", "rule_id", "rule_version").alias("k")
    o = table(spark, sf, "rule_outcome").where("quote is not null and rule_id is not null and rule_version is not null").select("outcome_id", k, "quote").distinct()
    p = table(spark, sf, "rule_pack").where("quote is not null").select(k, tx.numeric_signature(F.col("quote")).alias("want")).distinct()
    return salted_join(o, p, "k").select("outcome_id", (tx.numeric_signature(F.col("quote")) == F.col("want")).alias("same_numbers"))


@query(f"SELECT name, sum(hits)::BIGINT AS hits FROM (SELECT unnest([{', '.join('{' + chr(39) + 'name' + chr(39) + ': ' + chr(39) + n + chr(39) + ', ' + chr(39) + 'hits' + chr(39) + ': len(regexp_extract_all(text, ' + chr(39) + p + chr(39) + '))}' for n, p in (tx.INJECTIONS | {'zero-width-char': tx.ZERO_WIDTH}).items())}], recursive := true) FROM documents WHERE text IS NOT NULL) GROUP BY 1")
def txt10_instruction_scan(spark, sf):
    kinds = tx.INJECTIONS | {"zero-width-char": tx.ZERO_WIDTH}
    hits = F.array(*[F.struct(F.lit(n).alias("name"), F.regexp_count("text", F.lit(p)).cast("bigint").alias("hits")) for n, p in kinds.items()])
    return table(spark, sf, "documents").where("text is not null").select(F.inline(hits)).groupBy("name").agg(F.sum("hits").alias("hits"))


@query(rf"SELECT doc_id, length(text) - length(regexp_replace(text, '{tx.ZERO_WIDTH}', '', 'g')) AS dropped FROM documents WHERE text IS NOT NULL")
def txt11_sanitised(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", (F.length("text") - F.length(F.regexp_replace("text", tx.ZERO_WIDTH, ""))).cast("bigint").alias("dropped"))


def _by_line(docs: DataFrame) -> DataFrame:
    """Digest lines are left out where only numbers make an identifier."""
    digest = F.col("line").rlike(tx.DIGEST_WORDS) | F.col("line").rlike(tx.DIGEST_LINE)
    return docs.where("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).withColumn("digest", digest)


@query("WITH " + _DOCS + ", l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs WHERE text IS NOT NULL), m AS (SELECT *, regexp_matches(line, '(?i)(?:hash|sha256|sha16|digest)') OR regexp_matches(line, '^\\s*\"[0-9a-f]{8,}\"\\s*,?\\s*$') AS digest FROM l) SELECT kind, sum(n)::BIGINT AS hits, count(DISTINCT doc_id) AS documents FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, len(regexp_extract_all(line, '{p}')) AS n FROM m" + (" WHERE NOT digest" if k in tx.NUMERIC else "") for k, p in tx.IDENTIFIERS.items()) + ") WHERE n > 0 GROUP BY 1")
def txt13_identifiers(spark, sf):
    n = lambda k, p: F.when(F.col("digest"), 0).otherwise(F.regexp_count("line", F.lit(p))) if k in tx.NUMERIC else F.regexp_count("line", F.lit(p))
    hits = F.array(*[F.struct(F.lit(k).alias("kind"), n(k, p).cast("bigint").alias("n")) for k, p in tx.IDENTIFIERS.items()])
    return _by_line(with_planted(spark, sf)).select("doc_id", F.inline(hits)).where("n > 0").groupBy("kind").agg(F.sum("n").alias("hits"), F.countDistinct("doc_id").alias("documents"))


@query("SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{p}')) AS {k.lower()}" for k, p in tx.MARKERS.items()) + " FROM documents WHERE text IS NOT NULL")
def txt14_markers(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", *[F.regexp_count("text", F.lit(p)).cast("bigint").alias(k.lower()) for k, p in tx.MARKERS.items()])


@query("WITH " + _DOCS + " SELECT doc_id, CASE WHEN " + " OR ".join(f"regexp_matches(text, '{tx.IDENTIFIERS[k]}')" for k in tx.HARD) + f" OR regexp_matches(text, '{tx.PERSON_FIELDS}') THEN 'PRESENT' WHEN " + " OR ".join(f"regexp_matches(text, '{p}')" for k, p in tx.IDENTIFIERS.items() if k not in tx.HARD) + f" OR regexp_matches(text, '{tx.ANY_FIELD}') THEN 'SUSPECTED' ELSE 'NONE' END AS pii FROM docs WHERE text IS NOT NULL")
def txt15_pii_class(spark, sf):
    hard, soft = F.col("text").rlike(tx.PERSON_FIELDS), F.col("text").rlike(tx.ANY_FIELD)
    for k, p in tx.IDENTIFIERS.items():
        hard, soft = (hard | F.col("text").rlike(p), soft) if k in tx.HARD else (hard, soft | F.col("text").rlike(p))
    return with_planted(spark, sf).where("text is not null").select("doc_id", F.when(hard, "PRESENT").when(soft, "SUSPECTED").otherwise("NONE").alias("pii"))


@query(f"WITH {_C} SELECT clause_id, 'SP-' || upper(substr(h, 1, 16)) AS span_id, 'CL-' || upper(substr(h, 1, 20)) AS address FROM (SELECT clause_id, sha256(concat_ws('|', coalesce(document_id, ''), coalesce(page_number::VARCHAR, ''), coalesce(char_start::VARCHAR, ''), coalesce(char_end::VARCHAR, ''), coalesce(original_text, ''))) AS h FROM c)")
def txt21_span_addresses(spark, sf):
    h = tx.fingerprint(*[F.col(c) for c in ("document_id", "page_number", "char_start", "char_end", "original_text")])
    return _clauses(spark, sf).select("clause_id", F.concat(F.lit("SP-"), F.upper(F.substring(h, 1, 16))).alias("span_id"), F.concat(F.lit("CL-"), F.upper(F.substring(h, 1, 20))).alias("address"))


_HEAD = tx.HEADINGS[0]


@query(f"WITH p AS (SELECT DISTINCT ON (page_read_id) page_read_id, layout.text AS t FROM page_read WHERE layout.text IS NOT NULL), l AS (SELECT page_read_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS line_no FROM p) SELECT page_read_id, line_no, regexp_extract(line, '{_HEAD}', 1) AS label, trim(regexp_extract(line, '{_HEAD}', 2)) AS heading FROM l WHERE regexp_matches(line, '{_HEAD}')")
def txt24_headings(spark, sf):
    p = table(spark, sf, "page_read").dropDuplicates(["page_read_id"]).select("page_read_id", F.posexplode(F.split("layout.text", "\n")).alias("pos", "line")).where(F.col("line").rlike(_HEAD))
    return p.select("page_read_id", (F.col("pos") + 1).cast("bigint").alias("line_no"), F.regexp_extract("line", _HEAD, 1).alias("label"), F.trim(F.regexp_extract("line", _HEAD, 2)).alias("heading"))


# ---------------------------------------------------------------- ingestion


@query(rf"""WITH {_C}, q AS (SELECT DISTINCT citation_id, lower(trim(ref_id)) AS k, quote FROM citation WHERE ref_type = 'policy_clause' AND quote <> ''),
 j AS (SELECT q.citation_id, quote, original_text FROM q JOIN c ON lower(trim(c.clause_id)) = q.k WHERE original_text IS NOT NULL),
 x AS (SELECT citation_id, nullif(regexp_extract(quote, '(?i)(?:rs\.?|inr|₹)\s*(\d[\d,]*(?:\.\d+)?)', 1), '') AS a, nullif(regexp_extract(original_text, '(?i)(?:rs\.?|inr|₹)\s*(\d[\d,]*(?:\.\d+)?)', 1), '') AS b FROM j),
 r AS (SELECT citation_id, a FROM x UNION ALL SELECT citation_id, b FROM x), p AS (SELECT citation_id, {_PAISE} AS paise FROM r),
 g AS (SELECT citation_id, count(paise) AS n, count(DISTINCT paise) AS kinds, min(paise) AS paise FROM p GROUP BY 1), h AS (SELECT *, CASE WHEN n = 0 THEN 'no_reading' WHEN kinds > 1 THEN 'disagree' WHEN n = 1 THEN 'one_reader' ELSE 'agree' END AS agreement FROM g)
 SELECT citation_id AS subject, agreement, CASE agreement WHEN 'agree' THEN 'USABLE' WHEN 'no_reading' THEN 'EVIDENCE_GAP' ELSE 'QUARANTINED' END AS disposition, CASE WHEN agreement = 'agree' THEN paise END AS paise FROM h""")
def ing08_dual_reader(spark, sf):
    """The first amount read from the quote and from the clause it cites."""
    key = lambda c: F.lower(F.trim(c))
    q = table(spark, sf, "citation").where("ref_type = 'policy_clause' and quote <> ''").select("citation_id", key(F.col("ref_id")).alias("k"), "quote").distinct()
    c = _clauses(spark, sf).where("original_text is not null").select(key(F.col("clause_id")).alias("k"), "original_text")
    first = lambda t: money.decimal_paise(F.nullif(F.regexp_extract(t, money.PRICED, 1), F.lit("")))
    j = salted_join(q, c, "k").select(F.col("citation_id").alias("subject"), F.inline(F.array(F.struct(F.lit("quote").alias("reader"), first("quote").alias("paise")), F.struct(F.lit("clause").alias("reader"), first("original_text").alias("paise")))))
    return agreement(j)


@query(rf"""WITH {_C} SELECT clause_id, cast(CASE WHEN regexp_full_match(d, '\d{{4}}-\d{{2}}-\d{{2}}') THEN try_cast(d AS DATE) WHEN regexp_full_match(d, '\d{{1,2}}[/.-]\d{{1,2}}[/.-]\d{{4}}') THEN try_strptime(translate(d, '/.', '--'), '%d-%m-%Y')::DATE WHEN regexp_full_match(d, '\d{{1,2}} [A-Za-z]{{3}}[a-z]* \d{{4}}') THEN try_strptime(regexp_replace(d, '^(\d+ [A-Za-z]{{3}})[a-z]*', '\1'), '%d %b %Y')::DATE END AS VARCHAR) AS effective FROM (SELECT clause_id, trim(effective_date) AS d FROM c)""")
def ing10_effective_dates(spark, sf):
    return _clauses(spark, sf).select("clause_id", tx.iso_date(F.col("effective_date")).cast("string").alias("effective"))


_TYPES = {"policy_wording": "wording", "prospectus": "prospectus", "circular": "circular", "guidelines": "guideline", "list": "excluded items", "lexicon": "lexicon", "faq": "questions and answers"}


@query("SELECT corpus_document_id, CASE " + " ".join(f"WHEN contains(lower(title), '{v}') THEN '{k}'" for k, v in _TYPES.items()) + " ELSE 'other' END AS document_type FROM (SELECT DISTINCT corpus_document_id, title FROM corpus_document)")
def ing12_document_types(spark, sf):
    kind = F.coalesce(*[F.when(F.lower("title").contains(v), k) for k, v in _TYPES.items()], F.lit("other"))
    return table(spark, sf, "corpus_document").select("corpus_document_id", "title").distinct().select("corpus_document_id", kind.alias("document_type"))


@query(f"WITH {_C} SELECT CASE WHEN original_text IS NULL THEN 'no text' WHEN char_end IS NULL OR char_start IS NULL THEN 'no span' WHEN char_end < char_start THEN 'inverted' WHEN char_end - char_start <> length(original_text) THEN 'length differs' ELSE 'ok' END AS span_state, count(*) AS clauses FROM c GROUP BY 1")
def ing21_span_invariants(spark, sf):
    s, e, t = F.col("char_start"), F.col("char_end"), F.col("original_text")
    state = F.when(t.isNull(), "no text").when(e.isNull() | s.isNull(), "no span").when(e < s, "inverted").when(e - s != F.length(t), "length differs").otherwise("ok")
    return _clauses(spark, sf).groupBy(state.alias("span_state")).agg(F.count(F.lit(1)).alias("clauses"))


@query(f"WITH {_C}, l AS (SELECT clause_id, unnest(string_split(original_text, chr(10))) AS line, generate_subscripts(string_split(original_text, chr(10)), 1) AS line_no, length(original_text) // 2 AS mid FROM c WHERE original_text <> ''), s AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY clause_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM l) SELECT clause_id, line_no FROM s WHERE a <= mid AND mid < a + length(line) + 1")
def ing22_line_at_offset(spark, sf):
    """The line in which the middle of a text stands."""
    lines = text_lines(table(spark, sf, "policy_clause").where("original_text <> ''"), "clause_id", "original_text")
    mid = _clauses(spark, sf).where("original_text <> ''").select("clause_id", F.floor(F.length("original_text") / 2).alias("at"))
    return lines.join(mid, "clause_id").where("char_start <= at and at < char_end + 1").select("clause_id", "line_no")


# ---------------------------------------------------------------- corpus


@query("SELECT corpus_document_id, concat_ws('; ', CASE WHEN title IS NULL OR trim(title) = '' THEN 'no title' END, CASE WHEN reference IS NULL OR trim(reference) = '' THEN 'no reference' END, CASE WHEN source_url IS NULL AND NOT synthetic THEN 'no provenance' END, CASE WHEN effective_to < effective_from THEN 'dates inverted' END, CASE WHEN superseded_by IS NOT NULL AND superseded_on IS NULL THEN 'superseded without date' END) AS problems FROM (SELECT DISTINCT corpus_document_id, title, reference, source_url, synthetic, effective_from, effective_to, superseded_by, superseded_on FROM corpus_document)")
def cor04_document_problems(spark, sf):
    cols = ("corpus_document_id", "title", "reference", "source_url", "synthetic", "effective_from", "effective_to", "superseded_by", "superseded_on")
    d = table(spark, sf, "corpus_document").select(*cols).distinct()
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    problems = F.concat_ws("; ", F.when(blank("title"), "no title"), F.when(blank("reference"), "no reference"), F.when(F.col("source_url").isNull() & ~F.col("synthetic"), "no provenance"), F.when(F.col("effective_to") < F.col("effective_from"), "dates inverted"), F.when(F.col("superseded_by").isNotNull() & F.col("superseded_on").isNull(), "superseded without date"))
    return d.select("corpus_document_id", problems.alias("problems"))


@query("SELECT DISTINCT corpus_document_id FROM corpus_document WHERE effective_from <= DATE '2024-06-30' AND (effective_to IS NULL OR DATE '2024-06-30' <= effective_to) AND (superseded_on IS NULL OR DATE '2024-06-30' < superseded_on)")
def cor06_in_force(spark, sf):
    """As of a fixed date; the end of effect is inclusive, supersession is not."""
    day = F.lit("2024-06-30").cast("date")
    return table(spark, sf, "corpus_document").where((F.col("effective_from") <= day) & (F.col("effective_to").isNull() | (day <= F.col("effective_to"))) & (F.col("superseded_on").isNull() | (day < F.col("superseded_on")))).select("corpus_document_id").distinct()


@query("SELECT finding_id, ref_type, lower(trim(ref_id)) AS ref, min(citation_id) AS kept, count(DISTINCT citation_id) AS copies FROM citation GROUP BY 1, 2, 3")
def sec10_first_seen(spark, sf):
    return table(spark, sf, "citation").groupBy("finding_id", "ref_type", F.lower(F.trim("ref_id")).alias("ref")).agg(F.min("citation_id").alias("kept"), F.countDistinct("citation_id").alias("copies"))


@query("SELECT event_type, date_trunc('hour', ts) + to_minutes(cast(10 * (extract(minute FROM ts) // 10) AS BIGINT)) AS window_start, count(*) AS events FROM events GROUP BY 1, 2")
def str_windowed_events(spark, sf):
    from ledgerloom.streaming.intake import windowed_counts

    out = windowed_counts(table(spark, sf, "events"), "ts", "event_type")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


# ---------------------------------------------------------------- quotes and bills


@query()
def txt03_verified_quotes(spark, sf):
    """All tiers: exact, normalised, fuzzy with equal numbers and bearing words, ambiguous, rejected."""
    from ledgerloom.operators.evidence import verify_quotes

    key = lambda c: F.lower(F.trim(c)).alias("key")
    q = table(spark, sf, "citation").where("ref_type = 'policy_clause'").select("citation_id", key(F.col("ref_id")), "quote")
    t = table(spark, sf, "policy_clause").groupBy(key(F.col("clause_id"))).agg(F.max("original_text").alias("text"))
    return verify_quotes(q, t)


@query("SELECT document_id, page_number, count(*) AS readings, count(DISTINCT sha256(layout.text)) AS texts, count_if(layout.text IS NULL) AS without_text FROM page_read GROUP BY 1, 2")
def src01_page_readings(spark, sf):
    """How often each page was read, and whether the readings agree."""
    return table(spark, sf, "page_read").groupBy("document_id", "page_number").agg(F.count(F.lit(1)).alias("readings"), F.countDistinct(F.sha2("layout.text", 256)).alias("texts"), F.count_if(F.col("layout.text").isNull()).alias("without_text"))


@query("WITH p AS (SELECT DISTINCT ON (page_read_id) page_read_id, document_id, page_number, layout.method AS method, layout.text AS t FROM page_read), n AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_number, page_read_id) AS k FROM p WHERE method = 'ocr' OR t IS NULL OR length(t) < 12) SELECT document_id, page_read_id, k AS place FROM n")
def src03_scan_pages(spark, sf):
    """The pages of a document that need a scan, in order; a page cap, if one is wanted, is a bound on `place`."""
    p = table(spark, sf, "page_read").dropDuplicates(["page_read_id"]).select("page_read_id", "document_id", "page_number", F.col("layout.method").alias("method"), F.col("layout.text").alias("t"))
    need = p.where("method = 'ocr' or t is null or length(t) < 12")
    return need.select("document_id", "page_read_id", F.row_number().over(W.partitionBy("document_id").orderBy("page_number", "page_read_id")).cast("bigint").alias("place"))


@query("SELECT doc_id, '<document_text role=\"' || coalesce(source, 'unknown') || '\">' || chr(10) || regexp_replace(text, '" + tx.ZERO_WIDTH + "', '', 'g') || chr(10) || '</document_text>' AS wrapped FROM documents WHERE text IS NOT NULL")
def txt12_wrapped(spark, sf):
    body = F.regexp_replace("text", tx.ZERO_WIDTH, "")
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.concat(F.lit('<document_text role="'), F.coalesce("source", F.lit("unknown")), F.lit('">\n'), body, F.lit("\n</document_text>")).alias("wrapped"))


@query("WITH l AS (SELECT DISTINCT page_read_id, document_id, trim(line) AS line FROM (SELECT page_read_id, document_id, unnest(string_split(layout.text, chr(10))) AS line FROM page_read WHERE layout.text IS NOT NULL)), p AS (SELECT document_id, count(DISTINCT page_read_id) AS pages FROM page_read WHERE layout.text IS NOT NULL GROUP BY 1), n AS (SELECT document_id, line, count(*) AS n FROM l WHERE line <> '' GROUP BY 1, 2) SELECT document_id, line, n FROM n JOIN p USING (document_id) WHERE n >= 4 AND 2 * n >= pages")
def agg16_boilerplate(spark, sf):
    """Lines on at least four pages and half of the pages of a document."""
    p = table(spark, sf, "page_read").where("layout.text is not null").select("page_read_id", "document_id", F.col("layout.text").alias("t"))
    lines = p.select("page_read_id", "document_id", F.explode(F.split("t", "\n")).alias("line")).withColumn("line", F.trim("line")).where("line <> ''").distinct()
    n = lines.groupBy("document_id", "line").agg(F.count(F.lit(1)).alias("n")).where("n >= 4")
    pages = p.groupBy("document_id").agg(F.countDistinct("page_read_id").alias("pages"))
    return n.join(pages, "document_id").where("2 * n >= pages").select("document_id", "line", "n")


@query("SELECT finding_id, count(*) AS citations, count_if(verified) AS verified, count(DISTINCT ref_type) AS kinds, min(cited_at) AS first_cited, max(cited_at) AS last_cited FROM (SELECT DISTINCT * FROM citation) WHERE finding_id IS NOT NULL GROUP BY 1")
def agg23_finding_counts(spark, sf):
    c = table(spark, sf, "citation").where("finding_id is not null").distinct()
    return c.groupBy("finding_id").agg(F.count(F.lit(1)).alias("citations"), F.count_if("verified").alias("verified"), F.countDistinct("ref_type").alias("kinds"), F.min("cited_at").alias("first_cited"), F.max("cited_at").alias("last_cited"))


@query("SELECT DISTINCT d.corpus_document_id, d.superseded_by, CASE WHEN n.corpus_document_id IS NULL THEN 'successor missing' WHEN n.effective_from > d.superseded_on THEN 'gap' ELSE 'ok' END AS chain FROM corpus_document d LEFT JOIN (SELECT corpus_document_id, max(effective_from) AS effective_from FROM corpus_document GROUP BY 1) n ON d.superseded_by = n.corpus_document_id WHERE d.superseded_by IS NOT NULL")
def cor10_supersession(spark, sf):
    d = table(spark, sf, "corpus_document")
    nxt = d.groupBy(F.col("corpus_document_id").alias("superseded_by")).agg(F.max("effective_from").alias("next_from"), F.lit(True).alias("there"))
    j = d.where("superseded_by is not null").select("corpus_document_id", "superseded_by", "superseded_on").join(nxt, "superseded_by", "left")
    return j.select("corpus_document_id", "superseded_by", F.when(F.col("there").isNull(), "successor missing").when(F.col("next_from") > F.col("superseded_on"), "gap").otherwise("ok").alias("chain")).distinct()
