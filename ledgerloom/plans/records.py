"""Queries over histories of records: revisions, deletions, evidence, folds, orders, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import bills as bl
from ledgerloom.functions import text as tx
from ledgerloom.operators.hierarchy import Hierarchy
from ledgerloom.operators.records import align_lines, cursor_column, decoded_cursor, fold_steps, latest
from ledgerloom.operators.skew import salted_join
from ledgerloom.plans.general import _DOWN, _SPECS
from ledgerloom.plans.views import _J, _jobs
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


_E = "e AS (SELECT DISTINCT event_id, user_id, event_type, ts, value FROM events)"


def _events(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"), "value").distinct()


@query(f"WITH {_E}, c AS (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS new FROM e) SELECT event_id, user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS revision FROM c")
def sec03_revisions(spark, sf):
    """A record's revision goes up when its input changes, not when it is sent again as it was."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    c = _events(spark, sf).withColumn("new", F.when(F.lag("event_type").over(w) == F.col("event_type"), 0).otherwise(1))
    return c.select("event_id", "user_id", F.sum("new").over(w).cast("bigint").alias("revision"))


@query(f"WITH {_E}, k AS (SELECT *, sha256(user_id || '|' || event_type || '|' || cast(ts AS DATE)) AS key FROM e), f AS (SELECT key, min_by(event_id, (ts, event_id)) AS first, count(*) AS asked FROM k GROUP BY 1) SELECT key, first, asked FROM f")
def sec07_idempotent_requests(spark, sf):
    """The first request of each idempotency key is carried out, the others are answered with it."""
    key = F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "event_type", F.to_date("ts").cast("string")), 256)
    return _events(spark, sf).groupBy(key.alias("key")).agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first"), F.count(F.lit(1)).alias("asked"))


@query(f"WITH {_J}, t AS (SELECT case_id, min(created_at) AS deleted_at FROM j WHERE job_type = 'error' AND case_id % 4 = 0 GROUP BY 1) SELECT job_id, CASE WHEN t.case_id IS NOT NULL AND created_at <= deleted_at AND status IN ('QUEUED', 'RUNNING', 'RETRYABLE_FAILURE') THEN 'CANCELLED' ELSE status END AS status, t.case_id IS NOT NULL AND created_at > deleted_at AS refused FROM j LEFT JOIN t USING (case_id)")
def sec08_deletions(spark, sf):
    """A deletion cancels the open jobs there are, and refuses those that come later; nothing is rewritten."""
    j = _jobs(spark, sf)
    t = j.where("job_type = 'error' and case_id % 4 = 0").groupBy("case_id").agg(F.min("created_at").alias("deleted_at"))
    open_ = F.col("status").isin("QUEUED", "RUNNING", "RETRYABLE_FAILURE")
    x = j.join(t, "case_id", "left")
    return x.select("job_id", F.when((F.col("created_at") <= F.col("deleted_at")) & open_, "CANCELLED").otherwise(F.col("status")).alias("status"), F.coalesce(F.col("created_at") > F.col("deleted_at"), F.lit(False)).alias("refused"))


@query("WITH d AS (SELECT DISTINCT corpus_document_id FROM corpus_document WHERE deleted_at IS NOT NULL) SELECT DISTINCT clause_id FROM policy_clause c WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.corpus_document_id = c.document_id)")
def sec13_purged(spark, sf):
    """The clauses left when those of deleted documents are purged."""
    d = table(spark, sf, "corpus_document").where("deleted_at is not null").select(F.col("corpus_document_id").alias("document_id")).distinct()
    return table(spark, sf, "policy_clause").join(d, "document_id", "left_anti").select("clause_id").distinct()


@query(f"WITH {_E} SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS running FROM e")
def sec14_runs_with_totals(spark, sf):
    """A user's runs, newest first, with what had been summed up to each."""
    up, down = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0), W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return _events(spark, sf).select("user_id", "event_id", F.row_number().over(down).cast("bigint").alias("place"), F.round(F.sum("value").over(up), 4).alias("running"))


@query("SELECT page_read_id, 'pages/' || document_id || '/' || lpad(page_number::VARCHAR, 5, '0') || '-' || substr(sha256(t), 1, 16) || '.txt' AS key FROM (SELECT DISTINCT page_read_id, document_id, page_number, layout.text AS t FROM page_read) WHERE t IS NOT NULL")
def sec15_artifact_keys(spark, sf):
    p = table(spark, sf, "page_read").select("page_read_id", "document_id", "page_number", F.col("layout.text").alias("t")).distinct().where("t is not null")
    return p.select("page_read_id", F.concat(F.lit("pages/"), "document_id", F.lit("/"), F.lpad(F.col("page_number").cast("string"), 5, "0"), F.lit("-"), F.substring(F.sha2("t", 256), 1, 16), F.lit(".txt")).alias("key"))


@query("""WITH p AS (SELECT document_id, page_number, max_by(struct_pack(id := page_read_id, t := layout.text), (read_at, page_read_id)) AS x FROM (SELECT DISTINCT page_read_id, document_id, page_number, layout, read_at FROM page_read) WHERE read_at IS NOT NULL GROUP BY 1, 2), l AS (SELECT document_id, page_number, x.id AS id, unnest(string_split(x.t, chr(10))) AS line FROM p WHERE x.t IS NOT NULL)
 SELECT document_id, page_number, id AS page_read_id, count(*) AS lines, count_if(regexp_matches(line, '\\d')) AS with_digits FROM l GROUP BY 1, 2, 3""")
def sec05_fields_of_latest(spark, sf):
    """Figures of the latest reading of each page only."""
    p = table(spark, sf, "page_read").where("read_at is not null").select("document_id", "page_number", "read_at", "page_read_id", F.col("layout.text").alias("t")).distinct()
    last = latest(p, ["document_id", "page_number"], ["read_at", "page_read_id"]).where("t is not null")
    ls = last.select("document_id", "page_number", "page_read_id", F.explode(F.split("t", "\n")).alias("line"))
    return ls.groupBy("document_id", "page_number", "page_read_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("line").rlike(r"\d")).alias("with_digits"))


_V = r"q AS (SELECT DISTINCT citation_id, lower(trim(ref_id)) AS k, quote FROM citation WHERE ref_type = 'policy_clause' AND quote <> ''), c AS (SELECT lower(trim(clause_id)) AS k, max(original_text) AS t, max(document_id) AS d FROM policy_clause WHERE original_text IS NOT NULL GROUP BY 1), j AS (SELECT citation_id, quote, t, d, instr(t, quote) - 1 AS a FROM q JOIN c USING (k) WHERE (length(t) - length(replace(t, quote, ''))) // length(quote) = 1)"


def _evidence(spark, sf):
    key = lambda c: F.lower(F.trim(c))
    q = table(spark, sf, "citation").where("ref_type = 'policy_clause' and quote <> ''").select("citation_id", key("ref_id").alias("k"), "quote").distinct()
    c = table(spark, sf, "policy_clause").where("original_text is not null").groupBy(key("clause_id").alias("k")).agg(F.max("original_text").alias("t"), F.max("document_id").alias("d"))
    return salted_join(q, c, "k").where(tx.occurrences(F.col("t"), F.col("quote")) == 1).withColumn("a", F.instr("t", F.col("quote")) - 1)


@query(f"WITH {_V} SELECT citation_id, 'EV-' || upper(substr(sha256(concat_ws('|', coalesce(d, ''), a::VARCHAR, (a + length(quote))::VARCHAR, quote)), 1, 12)) AS evidence_id, sha256(t) AS text_hash FROM j")
def txt08_evidence(spark, sf):
    """Evidence of quotes that stand once, with ids made of where they stand and the hash of the text."""
    h = tx.fingerprint(F.col("d"), F.col("a"), F.col("a") + F.length("quote"), F.col("quote"))
    return _evidence(spark, sf).select("citation_id", F.concat(F.lit("EV-"), F.upper(F.substring(h, 1, 12))).alias("evidence_id"), F.sha2("t", 256).alias("text_hash"))


@query(f"WITH {_V}, s AS (SELECT citation_id, quote, a, CASE WHEN citation_id % 5 = 0 THEN 'x' || t ELSE t END AS now, sha256(t) AS stored FROM j) SELECT citation_id, sha256(now) = stored AS intact, substr(now, (a + 1)::BIGINT, length(quote)) = quote AS readable FROM s")
def sec06_evidence_integrity(spark, sf):
    """Stored evidence against the text as it is now; one text in five has changed since."""
    now = F.when(F.col("citation_id") % 5 == 0, F.concat(F.lit("x"), "t")).otherwise(F.col("t"))
    s = _evidence(spark, sf).select("citation_id", "quote", "a", now.alias("now"), F.sha2("t", 256).alias("stored"))
    return s.select("citation_id", (F.sha2("now", 256) == F.col("stored")).alias("intact"), (F.substring(F.col("now"), F.col("a") + 1, F.length("quote")) == F.col("quote")).alias("readable"))


@query("""WITH q AS (SELECT DISTINCT citation_id, document_id, quote FROM citation WHERE length(quote) >= 12 AND document_id IS NOT NULL), c AS (SELECT DISTINCT clause_id, document_id, original_text AS t FROM policy_clause WHERE original_text IS NOT NULL) SELECT citation_id, min_by(clause_id, (NOT contains(t, quote), abs(length(t) - length(quote)), clause_id)) AS clause_id, bool_or(contains(t, quote)) AS found FROM q JOIN c USING (document_id) GROUP BY 1""")
def srt07_best_clause(spark, sf):
    """Of the clauses of a quote's document one that holds it, then the one nearest in length, then the smaller id. Documents cited very often are salted."""
    q = table(spark, sf, "citation").where("length(quote) >= 12 and document_id is not null").select("citation_id", "document_id", "quote").distinct()
    c = table(spark, sf, "policy_clause").where("original_text is not null and document_id is not null").select("clause_id", "document_id", F.col("original_text").alias("t")).distinct()
    has = F.col("t").contains(F.col("quote"))
    return salted_join(q, c, "document_id").groupBy("citation_id").agg(F.min(F.struct((~has).alias("no"), F.abs(F.length("t") - F.length("quote")).alias("off"), "clause_id")).alias("x")).select("citation_id", "x.clause_id", (~F.col("x.no")).alias("found"))


@query("SELECT * FROM (SELECT DISTINCT citation_id, ref_type AS kind, citation_id::VARCHAR AS id, NULL AS error FROM citation UNION ALL VALUES (-1, NULL, NULL, 'INVALID_CURSOR'), (-2, NULL, NULL, 'INVALID_CURSOR'), (-3, NULL, NULL, 'INVALID_CURSOR')) v(citation_id, kind, id, error)")
def srt03_decoded_cursors(spark, sf):
    """Cursors read back; one that is too long, one that is no base64 and one that is no list are refused."""
    c = table(spark, sf, "citation").select("citation_id", cursor_column(F.col("ref_type"), F.col("citation_id").cast("string")).alias("cursor")).distinct()
    bad = spark.createDataFrame([(-1, "A" * 600), (-2, "%%%"), (-3, "e30")], "citation_id bigint, cursor string")
    return c.unionByName(bad).select("citation_id", decoded_cursor(F.col("cursor"), 2).alias("x")).select("citation_id", F.get("x.values", F.lit(0)).alias("kind"), F.get("x.values", F.lit(1)).alias("id"), "x.error")


@query("""WITH s AS (SELECT l_orderkey, l_partkey, l_returnflag AS f, cast(round(l_extendedprice * 100) AS BIGINT) AS v FROM (SELECT DISTINCT l_orderkey, l_partkey, l_returnflag, l_extendedprice FROM lineitem)), o AS (SELECT l_orderkey, list(CASE f WHEN 'A' THEN v // 10 WHEN 'N' THEN -(v * 20) ELSE 0 END ORDER BY l_partkey, f, v) AS steps FROM s GROUP BY 1)
 SELECT l_orderkey, list_reduce(list_prepend(100000000::BIGINT, steps), lambda a, x: CASE WHEN x < 0 THEN least(a, -x) ELSE a - x END) AS running FROM o""")
def win07_running_amount(spark, sf):
    """An amount carried through an order's lines in order: some are subtracted, some cap what is left."""
    v = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    s = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", F.col("l_returnflag").alias("f"), "l_extendedprice").distinct()
    s = s.select("l_orderkey", "l_partkey", "f", v.alias("v"), F.when(F.col("f") == "A", "subtract").when(F.col("f") == "N", "cap").otherwise("identity").alias("op"), F.when(F.col("f") == "A", F.floor(v / 10)).otherwise(v * 20).cast("bigint").alias("amount"))
    return fold_steps(s, "l_orderkey", ["l_partkey", "f", "v"], "op", "amount", F.lit(100_000_000).cast("bigint")).withColumnRenamed("result", "running")


@query(f"WITH RECURSIVE {_SPECS}, {_DOWN} SELECT corpus_document_id, label, row_number() OVER (PARTITION BY corpus_document_id ORDER BY depth, label) AS place FROM down")
def win12_topological_order(spark, sf):
    """Specs of a document so that each comes after its parent, those of one depth by label; circles have no order."""
    h = Hierarchy(table(spark, sf, "clause_spec"), "corpus_document_id", "label", "parent_label", "declared_at")
    t = h.table().where("state = 'tree'")
    return t.select(F.col("grp").alias("corpus_document_id"), "label", F.row_number().over(W.partitionBy("grp").orderBy("depth", "label")).cast("bigint").alias("place"))


@query("SELECT case_id, '# ' || case_id || chr(10) || string_agg('- ' || rule_id || ' v' || rule_version || ': ' || coalesce(outcome, 'none'), chr(10) ORDER BY rule_id, rule_version, outcome_id) AS report FROM (SELECT DISTINCT outcome_id, case_id, rule_id, rule_version, outcome FROM rule_outcome WHERE case_id IS NOT NULL AND rule_id IS NOT NULL AND rule_version IS NOT NULL) GROUP BY 1")
def src20_markdown(spark, sf):
    """A report per case: a heading and a line an outcome."""
    o = table(spark, sf, "rule_outcome").where("case_id is not null and rule_id is not null and rule_version is not null").select("outcome_id", "case_id", "rule_id", "rule_version", "outcome").distinct()
    line = F.concat(F.lit("- "), "rule_id", F.lit(" v"), F.col("rule_version").cast("string"), F.lit(": "), F.coalesce("outcome", F.lit("none")))
    g = o.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("rule_id", "rule_version", "outcome_id", line.alias("line")))).alias("x"))  # the outcomes of one case
    return g.select("case_id", F.concat(F.lit("# "), "case_id", F.lit("\n"), F.array_join("x.line", "\n")).alias("report"))


@query("SELECT case_id, count(*) FILTER (outcome = 'contested') AS contested, sum(length(coalesce(quote, ''))) FILTER (outcome = 'applies')::BIGINT AS quoted, array_to_string(list_sort(list_distinct(list(rule_id) FILTER (outcome = 'unverified'))), ', ') AS unverified FROM (SELECT DISTINCT outcome_id, case_id, rule_id, outcome, quote FROM rule_outcome WHERE case_id IS NOT NULL) GROUP BY 1")
def src21_letter_figures(spark, sf):
    """What a letter of a case states: how much is contested, how long the quotes in force are, which rules are unverified."""
    o = table(spark, sf, "rule_outcome").where("case_id is not null").select("outcome_id", "case_id", "rule_id", "outcome", "quote").distinct()
    of = lambda v: F.col("outcome") == v
    return o.groupBy("case_id").agg(F.count_if(of("contested")).alias("contested"), F.sum(F.when(of("applies"), F.length(F.coalesce("quote", F.lit(""))))).cast("bigint").alias("quoted"), F.array_join(F.array_sort(F.collect_set(F.when(of("unverified"), F.col("rule_id")))), ", ").alias("unverified"))


ORACLE["src21_letter_figures"] = ORACLE["src21_letter_figures"].replace("array_to_string(", "coalesce(array_to_string(").replace("', ') AS unverified", "', '), '') AS unverified")


@query("SELECT l_orderkey, count(*) AS lines, sum(cast(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS paise FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1")
def prd17_category_filter(spark, sf):
    return table(spark, sf, "lineitem").where(F.col("l_returnflag").isin("A", "N")).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("paise"))


@query("SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'R' AND l_discount > 0.05 THEN cast(round(l_extendedprice * 100) AS BIGINT) ELSE 0 END)::BIGINT AS supported FROM lineitem GROUP BY 1")
def agg08_supported_total(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(F.when((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.05), F.round(F.col("l_extendedprice") * 100).cast("bigint")).otherwise(0)).alias("supported"))


@query("WITH c AS (SELECT DISTINCT clause_id, document_id, page_number, char_start, heading_label FROM policy_clause WHERE document_id IS NOT NULL AND page_number IS NOT NULL) SELECT clause_id, coalesce(heading_label IS NULL AND lag(page_number) OVER w = page_number - 1, FALSE) AS continues FROM c WINDOW w AS (PARTITION BY document_id ORDER BY page_number, char_start, clause_id)")
def sec37_continuations(spark, sf):
    """A clause without a heading goes on from the page before if the document's clause before it stands there."""
    c = table(spark, sf, "policy_clause").where("document_id is not null and page_number is not null").select("clause_id", "document_id", "page_number", "char_start", "heading_label").distinct()
    before = F.lag("page_number").over(W.partitionBy("document_id").orderBy("page_number", "char_start", "clause_id"))
    return c.select("clause_id", F.coalesce(F.col("heading_label").isNull() & (before == F.col("page_number") - 1), F.lit(False)).alias("continues"))


@query("SELECT page_read_id, 'SCAN_DOUBT(page=' || page_number || ', sha16=' || substr(sha256(t), 1, 16) || ')' AS reason FROM (SELECT DISTINCT page_read_id, page_number, layout.text AS t, layout.mean_confidence AS c FROM page_read) WHERE t IS NOT NULL AND c < 0.8")
def txt17_reasons(spark, sf):
    """Reasons that say where and what, never the text."""
    p = table(spark, sf, "page_read").select("page_read_id", "page_number", F.col("layout.text").alias("t"), F.col("layout.mean_confidence").alias("c")).distinct().where("t is not null and c < 0.8")
    return p.select("page_read_id", tx.reason("SCAN_DOUBT", page=F.col("page_number"), sha16=F.substring(F.sha2("t", 256), 1, 16)).alias("reason"))


@query("SELECT doc_id, line_no, CASE WHEN line_no % 5 = 0 THEN 'one_reader' ELSE 'agree' END AS agreement, paise FROM (SELECT doc_id, line_no, CASE WHEN line_no % 5 <> 0 THEN cast(replace(replace(s[len(s)], ',', ''), '.', '') AS BIGINT) END AS paise FROM (SELECT doc_id, line_no, regexp_extract_all(line, '\\d[\\d,]*\\.\\d{2}') AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE lower(trim(source)) = 'hospital_bill' AND text IS NOT NULL)) WHERE len(s) > 0)")
def ing01_bill_parse(spark, sf):
    """Bills read twice, the second reading without every fifth line: lines are aligned, and an amount counts only where both readings have it."""
    d = table(spark, sf, "documents").where("lower(trim(source)) = 'hospital_bill' and text is not null").select(F.col("doc_id").cast("string").alias("page"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    a = d.select("page", (F.col("pos") + 1).cast("bigint").alias("line_no"), "line")
    b = a.where("line_no % 5 <> 0")
    pairs = align_lines(a, b, window=6, least=0.999)
    read = lambda df, no, p: df.select("page", F.col("line_no").alias(no), bl.bill_line(F.col("line"))["strict_paise"].alias(p))
    x = pairs.join(read(a, "left_no", "pa"), ["page", "left_no"]).join(read(b, "right_no", "pb"), ["page", "right_no"], "left").where("pa is not null")
    one = F.col("right_no").isNull()
    return x.select(F.col("page").cast("bigint").alias("doc_id"), F.col("left_no").alias("line_no"), F.when(one, "one_reader").when(F.col("pa") == F.col("pb"), "agree").otherwise("disagree").alias("agreement"), F.when(~one & (F.col("pa") == F.col("pb")), F.col("pa")).alias("paise"))
