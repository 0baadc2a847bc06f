"""Queries over records that change: jobs and their leases, latest states, lists, sets, links and corpus checks. The jobs are made of the events, a case is a user."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import text as tx
from ledgerloom.operators import links as lk
from ledgerloom.operators.records import agreement, keyset_page, latest
from ledgerloom.operators.skew import salted_join
from ledgerloom.session import table
from ledgerloom.streaming import intake

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- jobs

_STATUS = ("QUEUED", "RUNNING", "SUCCEEDED", "FAILED", "RETRYABLE_FAILURE", "CANCELLED")
_NOW = dt.datetime(2024, 1, 20)


def _jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs at a moment: one an event, with states, attempts and times in fixed classes."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts")).distinct()
    k = F.col("event_id")
    return e.select(
        k.alias("job_id"), F.col("user_id").alias("case_id"), (F.col("user_id") % 3).alias("owner_id"), F.col("event_type").alias("job_type"),
        F.element_at(F.array(*map(F.lit, _STATUS)), (k % 6 + 1).cast("int")).alias("status"), (F.floor(k / 6) % 4).cast("int").alias("attempts"),
        (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), (k % 7).cast("int"))).alias("available_at"),
        F.when(k % 6 == 1, F.col("ts") + F.expr("interval 2 minutes")).alias("lease_expires_at"), F.col("ts").alias("created_at"),
    )


_J = """j AS (SELECT DISTINCT event_id AS job_id, user_id AS case_id, user_id % 3 AS owner_id, event_type AS job_type, ['QUEUED','RUNNING','SUCCEEDED','FAILED','RETRYABLE_FAILURE','CANCELLED'][(event_id % 6 + 1)::INT] AS status, (event_id // 6 % 4)::INT AS attempts,
 ts + to_minutes((event_id % 7)::INT) AS available_at, CASE WHEN event_id % 6 = 1 THEN ts + to_minutes(2) END AS lease_expires_at, ts AS created_at FROM events), n AS (SELECT TIMESTAMP '2024-01-20 00:00:00' AS now)"""
_CLAIM = "(status IN ('QUEUED', 'RETRYABLE_FAILURE') OR status = 'RUNNING' AND lease_expires_at <= now) AND available_at <= now AND attempts < 3"


@query(f"WITH {_J} SELECT job_id, case_id, row_number() OVER (PARTITION BY case_id ORDER BY available_at, created_at, job_id) AS turn FROM j, n WHERE {_CLAIM}")
def str01_claimable(spark, sf):
    """The jobs that can be claimed, in the order in which each case's come."""
    c = intake.claimable(_jobs(spark, sf), F.lit(_NOW).cast("timestamp_ntz"))
    return c.select("job_id", "case_id", F.row_number().over(W.partitionBy("case_id").orderBy("available_at", "created_at", "job_id")).cast("bigint").alias("turn"))


@query(f"WITH {_J} SELECT job_id FROM j, n WHERE status = 'RUNNING' AND lease_expires_at <= now AND attempts >= 3")
def str06_exhausted(spark, sf):
    return intake.exhausted(_jobs(spark, sf), F.lit(_NOW).cast("timestamp_ntz")).select("job_id")


_SCRIPTS = {  # seconds, action, owner
    0: [],
    1: [(10, "claim", "w1")],
    2: [(10, "claim", "w1"), (20, "complete", "w1")],
    3: [(10, "claim", "w1"), (20, "complete", "w2")],
    4: [(10, "claim", "w1"), (20, "fail", "w1")],
    5: [(10, "claim", "w1"), (20, "fail", "w1"), (30, "claim", "w2"), (51, "claim", "w3")],
    6: [(10, "claim", "w1"), (200, "claim", "w2")],
    7: [(t + 40 * k, a, "w1") for k in range(3) for t, a in ((10, "claim"), (15, "fail"))],
    8: [(10, "claim", "w1"), (200, "claim", "w2"), (400, "claim", "w3"), (600, "claim", "w4")],
    9: [(10, "claim", "w1"), (100, "renew", "w1"), (150, "claim", "w2"), (200, "complete", "w1")],
    10: [(10, "claim", "w1"), (20, "abort", "w1"), (60, "claim", "w2")],
}


@query("""SELECT DISTINCT event_id::VARCHAR AS job_id, CASE event_id % 11 WHEN 0 THEN 'QUEUED' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'SUCCEEDED' WHEN 3 THEN 'RUNNING' WHEN 4 THEN 'RETRYABLE_FAILURE' WHEN 5 THEN 'RUNNING' WHEN 6 THEN 'RUNNING' WHEN 7 THEN 'FAILED' WHEN 8 THEN 'FAILED' WHEN 9 THEN 'SUCCEEDED' ELSE 'FAILED' END AS status,
 CASE event_id % 11 WHEN 0 THEN 0 WHEN 5 THEN 2 WHEN 6 THEN 2 WHEN 7 THEN 3 WHEN 8 THEN 3 ELSE 1 END AS attempts, CASE event_id % 11 WHEN 1 THEN 'w1' WHEN 3 THEN 'w1' WHEN 5 THEN 'w3' WHEN 6 THEN 'w2' END AS owner,
 CASE event_id % 11 WHEN 4 THEN 'REPORTED' WHEN 7 THEN 'REPORTED' WHEN 8 THEN 'LEASE_EXPIRED' WHEN 10 THEN 'REPORTED' END AS error FROM events""")
def str04_job_states(spark, sf):
    """Every event a job that goes through one of eleven histories: waiting, claimed, done, done by a stranger, failed once, claimed too early and again, lost and claimed by another,
    failed for good, lost for good, renewed, aborted."""
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts")).distinct()
    steps = F.create_map(*[x for k, v in _SCRIPTS.items() for x in (F.lit(k), F.array(*[F.struct(F.lit(s).alias("s"), F.lit(a).alias("action"), F.lit(o).alias("owner")) for s, a, o in [(0, "submit", "x"), *v]]))])
    r = e.select(F.col("event_id").cast("string").alias("job_id"), "ts", F.explode(F.element_at(steps, (F.col("event_id") % 11).cast("int"))).alias("x"))
    r = r.select("job_id", "x.action", "x.owner", (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("x.s").cast("decimal(18,6)"))).alias("at"))
    return intake.leases(r).select("job_id", "status", "attempts", "owner", "error")


@query(f"WITH {_J}, c AS (SELECT DISTINCT user_id AS case_id, user_id % 3 AS owner_id FROM events WHERE user_id % 5 <> 0) SELECT job_id, j.case_id, job_type, status FROM j JOIN c ON j.case_id = c.case_id AND j.owner_id = c.owner_id")
def jon02_jobs_of_cases(spark, sf):
    cases = table(spark, sf, "events").where("user_id % 5 <> 0").select(F.col("user_id").alias("case_id"), (F.col("user_id") % 3).alias("owner_id")).distinct()
    return _jobs(spark, sf).join(cases, ["case_id", "owner_id"]).select("job_id", "case_id", "job_type", "status")


@query(f"WITH {_J} SELECT case_id, count(*) AS jobs, count_if(status IN ('QUEUED', 'RUNNING', 'RETRYABLE_FAILURE')) AS active, count_if(status = 'SUCCEEDED') AS succeeded, count_if(status = 'FAILED') AS failed, count_if(status = 'CANCELLED') AS cancelled FROM j GROUP BY 1")
def agg23_job_counts(spark, sf):
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return _jobs(spark, sf).groupBy("case_id").agg(F.count(F.lit(1)).alias("jobs"), n("QUEUED", "RUNNING", "RETRYABLE_FAILURE").alias("active"), n("SUCCEEDED").alias("succeeded"), n("FAILED").alias("failed"), n("CANCELLED").alias("cancelled"))


@query(f"WITH {_J} SELECT case_id, job_type, max_by(job_id, (created_at, job_id)) AS job_id, max_by(status, (created_at, job_id)) AS status FROM j GROUP BY 1, 2")
def sec11_latest_job(spark, sf):
    return latest(_jobs(spark, sf).select("case_id", "job_type", "created_at", "job_id", "status"), ["case_id", "job_type"], ["created_at", "job_id"]).drop("created_at")


@query(f"WITH {_J} SELECT job_id, created_at FROM j WHERE job_type = 'error' AND status IN ('FAILED', 'RETRYABLE_FAILURE') AND (created_at, job_id) < (TIMESTAMP '2024-01-18 00:00:00', 0) ORDER BY created_at DESC, job_id DESC LIMIT 26")
def srt05_job_page(spark, sf):
    """A page of one type of jobs in two states."""
    j = _jobs(spark, sf).where("job_type = 'error' and status in ('FAILED', 'RETRYABLE_FAILURE')").select("job_id", "created_at")
    return keyset_page(j, ["created_at", "job_id"], 26, (dt.datetime(2024, 1, 18), 0))


@query("SELECT doc_id, created_at FROM documents WHERE created_at < TIMESTAMP '2025-06-01 00:00:00' OR created_at = TIMESTAMP '2025-06-01 00:00:00' AND doc_id < 0 ORDER BY created_at DESC, doc_id DESC LIMIT 26")
def srt04_document_page(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("created_at").cast("timestamp_ntz").alias("created_at"))
    return keyset_page(d, ["created_at", "doc_id"], 26, (dt.datetime(2025, 6, 1), 0))


@query(f"WITH {_J} SELECT job_id, CASE WHEN status = 'RUNNING' AND lease_expires_at <= now THEN CASE WHEN attempts >= 3 THEN 'FAILED' ELSE 'QUEUED' END ELSE status END AS after FROM j, n")
def sec17_recovery(spark, sf):
    """What becomes of each job when a crashed worker's leases have run out."""
    now = F.lit(_NOW).cast("timestamp_ntz")
    lost = (F.col("status") == "RUNNING") & (F.col("lease_expires_at") <= now)
    return _jobs(spark, sf).select("job_id", F.when(lost, F.when(F.col("attempts") >= 3, "FAILED").otherwise("QUEUED")).otherwise(F.col("status")).alias("after"))


@query(f"WITH {_J} SELECT job_id, md5(concat_ws('|', case_id, job_type, status)) AS etag, attempts < 3 AND status = 'RETRYABLE_FAILURE' AS will_retry FROM j")
def sec02_job_views(spark, sf):
    j = _jobs(spark, sf)
    return j.select("job_id", F.md5(F.concat_ws("|", "case_id", "job_type", "status")).alias("etag"), ((F.col("attempts") < 3) & (F.col("status") == "RETRYABLE_FAILURE")).alias("will_retry"))


# ---------------------------------------------------------------- cases and their documents

_ROLE = "CASE lower(trim(source)) WHEN 'policy_wording' THEN 'policy_wording' WHEN 'regulator_circular' THEN 'policy_schedule' WHEN 'hospital_bill' THEN 'bill' WHEN 'settlement_letter' THEN 'settlement' END"
_ROLES = {"policy_wording": "policy_wording", "regulator_circular": "policy_schedule", "hospital_bill": "bill", "settlement_letter": "settlement"}
_D = f"d AS (SELECT doc_id, case_id, {_ROLE} AS role, sha256(text) AS sha, created_at, n_chars FROM documents)"


def _roles(spark, sf) -> DataFrame:
    s = F.lower(F.trim("source"))
    role = F.coalesce(*[F.when(s == k, v) for k, v in _ROLES.items()])
    return table(spark, sf, "documents").select("doc_id", "case_id", role.alias("role"), F.sha2("text", 256).alias("sha"), F.col("created_at").cast("timestamp_ntz").alias("created_at"), "n_chars")


@query(f"WITH {_D} SELECT case_id, role, max_by(doc_id, (created_at, doc_id)) AS doc_id FROM d WHERE case_id IS NOT NULL AND role IS NOT NULL AND sha IS NOT NULL GROUP BY 1, 2")
def jon03_roles_of_cases(spark, sf):
    """The document last assigned to each role of a case, among those that have a text."""
    d = _roles(spark, sf)
    assigned = d.where("case_id is not null and role is not null").select("case_id", "role", "created_at", "doc_id")
    return latest(assigned.join(d.where("sha is not null").select("doc_id"), "doc_id", "left_semi"), ["case_id", "role"], ["created_at", "doc_id"]).drop("created_at")


_FOUR = ("policy_wording", "policy_schedule", "bill", "settlement")


@query(f"WITH {_D} SELECT case_id, " + ", ".join(f"CASE WHEN count_if(role = '{r}') > 0 THEN 'PRESENT' ELSE 'MISSING' END AS {r}" for r in _FOUR) + " FROM d WHERE case_id IS NOT NULL GROUP BY 1")
def sec01_checklist(spark, sf):
    """Which roles of a case have a document."""
    has = lambda r: F.when(F.count_if(F.col("role") == r) > 0, "PRESENT").otherwise("MISSING").alias(r)
    return _roles(spark, sf).where("case_id is not null").groupBy("case_id").agg(*map(has, _FOUR))


@query(f"WITH {_D} SELECT case_id, concat_ws(' ', " + ", ".join(f"CASE WHEN count(*) FILTER (role = '{r}') = 0 THEN '{r}' END" for r in ("policy_wording", "bill", "settlement")) + ") AS missing FROM d WHERE case_id IS NOT NULL GROUP BY 1")
def prd19_missing_documents(spark, sf):
    lack = lambda r: F.when(F.count_if(F.col("role") == r) == 0, r)
    return _roles(spark, sf).where("case_id is not null").groupBy("case_id").agg(F.concat_ws(" ", *[lack(r) for r in ("policy_wording", "bill", "settlement")]).alias("missing"))


@query(f"WITH {_D}, c AS (SELECT DISTINCT case_id FROM d WHERE case_id IS NOT NULL), r AS (SELECT unnest(['policy_wording', 'policy_schedule', 'bill', 'settlement']) AS role) SELECT c.case_id, r.role FROM c, r WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.case_id = c.case_id AND d.role = r.role)")
def jon12_roles_not_there(spark, sf):
    """The roles a case needs and has no document for, one row each."""
    d = _roles(spark, sf).where("case_id is not null")
    need = d.select("case_id").distinct().select("case_id", F.explode(F.array(*map(F.lit, _FOUR))).alias("role"))
    return need.join(d.select("case_id", "role").distinct(), ["case_id", "role"], "left_anti")


@query(f"WITH {_D}, l AS (SELECT case_id, role, max_by(doc_id, (created_at, doc_id)) AS doc_id FROM d WHERE case_id IS NOT NULL AND role IS NOT NULL GROUP BY 1, 2) SELECT d.doc_id, d.role, l.doc_id IS NOT NULL AS selected FROM d LEFT JOIN l ON d.case_id = l.case_id AND d.role = l.role AND d.doc_id = l.doc_id")
def sec04_documents_with_selection(spark, sf):
    d = _roles(spark, sf).select("doc_id", "case_id", "role", "created_at")
    last = latest(d.where("case_id is not null and role is not null"), ["case_id", "role"], ["created_at", "doc_id"]).select("doc_id", F.lit(True).alias("picked"))
    return d.join(last, "doc_id", "left").select("doc_id", "role", F.coalesce("picked", F.lit(False)).alias("selected"))


@query(f"WITH {_D} SELECT doc_id, CASE WHEN sha IS NULL THEN 'refused' WHEN row_number() OVER (PARTITION BY case_id, sha ORDER BY created_at, doc_id) = 1 THEN 'accepted' ELSE 'duplicate' END AS outcome FROM d WHERE case_id IS NOT NULL")
def sec09_active_duplicates(spark, sf):
    """The first document of a content in a case is kept, later ones are its duplicates."""
    d = _roles(spark, sf).where("case_id is not null")
    first = d.where("sha is not null").groupBy("case_id", "sha").agg(F.min(F.struct("created_at", "doc_id")).alias("f")).select("case_id", "sha", F.col("f.doc_id").alias("first"))
    return d.join(first, ["case_id", "sha"], "left").select("doc_id", F.when(F.col("sha").isNull(), "refused").when(F.col("first") == F.col("doc_id"), "accepted").otherwise("duplicate").alias("outcome"))


@query(f"WITH {_D}, a AS (SELECT doc_id, 'documents/' || sha AS key, sha FROM d WHERE sha IS NOT NULL), w AS (SELECT key, count(*) AS writers, count(DISTINCT sha) AS contents FROM a GROUP BY 1) SELECT key, writers, contents = 1 AS accepted FROM w")
def sec16_immutable_puts(spark, sf):
    """Keys by content: writing the same again is fine, writing another content under a key is refused."""
    a = _roles(spark, sf).where("sha is not null").select(F.concat(F.lit("documents/"), "sha").alias("key"), "sha")
    return a.groupBy("key").agg(F.count(F.lit(1)).alias("writers"), F.countDistinct("sha").alias("n")).select("key", "writers", (F.col("n") == 1).alias("accepted"))


@query("SELECT content_id, min(doc_id) AS first_id, min_by(issuer, doc_id) AS issuer, max(n_chars) AS chars, count(*) AS copies FROM (SELECT sha256(text) AS content_id, doc_id, issuer, n_chars FROM documents WHERE text IS NOT NULL) GROUP BY 1")
def sec40_merged_registry(spark, sf):
    """The first identity of a content with the richest of its other fields."""
    d = table(spark, sf, "documents").where("text is not null").select(F.sha2("text", 256).alias("content_id"), "doc_id", "issuer", "n_chars")
    return d.groupBy("content_id").agg(F.min("doc_id").alias("first_id"), F.min_by("issuer", F.when(F.col("issuer").isNotNull(), F.col("doc_id"))).alias("issuer"), F.max("n_chars").alias("chars"), F.count(F.lit(1)).alias("copies"))


@query("SELECT DISTINCT s AS given, CASE lower(trim(s)) WHEN 'policy' THEN 'policy_wording' WHEN 'policy_wording' THEN 'policy_wording' WHEN 'policy_schedule' THEN 'policy_schedule' WHEN 'hospital_bill' THEN 'bill' WHEN 'bill' THEN 'bill' WHEN 'settlement_letter' THEN 'settlement' WHEN 'settlement' THEN 'settlement' END AS role FROM (SELECT source AS s FROM documents UNION ALL SELECT unnest(['Policy ', ' BILL', 'settlement', 'policy_schedule', 'letter']))")
def src17_role_aliases(spark, sf):
    """Seven names of four roles; anything else is none."""
    given = table(spark, sf, "documents").select(F.col("source").alias("s")).union(spark.createDataFrame([(x,) for x in ("Policy ", " BILL", "settlement", "policy_schedule", "letter")], "s string")).distinct()
    return given.select(F.col("s").alias("given"), tx.document_role(F.col("s")).alias("role"))


# ---------------------------------------------------------------- runs, corrections, numbering

_P = "p AS (SELECT DISTINCT page_read_id, document_id, page_number, read_at FROM page_read)"


def _page_runs(spark, sf):
    return table(spark, sf, "page_read").select("page_read_id", "document_id", "page_number", F.col("read_at").cast("timestamp_ntz").alias("read_at")).distinct()


@query(f"WITH {_P} SELECT document_id, max_by(page_read_id, (read_at, page_read_id)) AS page_read_id, max(read_at) AS read_at FROM p WHERE read_at IS NOT NULL GROUP BY 1")
def win02_latest_run(spark, sf):
    return latest(_page_runs(spark, sf).where("read_at is not null").select("document_id", "read_at", "page_read_id"), ["document_id"], ["read_at", "page_read_id"])


@query("SELECT finding_id, ref_type, max_by(citation_id, (loaded_at, citation_id)) AS citation_id FROM citation WHERE finding_id IS NOT NULL AND loaded_at IS NOT NULL GROUP BY 1, 2")
def win03_latest_correction(spark, sf):
    c = table(spark, sf, "citation").where("finding_id is not null and loaded_at is not null").select("finding_id", "ref_type", "loaded_at", "citation_id")
    return latest(c, ["finding_id", "ref_type"], ["loaded_at", "citation_id"]).drop("loaded_at")


@query(f"WITH {_P} SELECT page_read_id, document_id, row_number() OVER (PARTITION BY document_id ORDER BY read_at DESC, page_read_id DESC) AS place FROM p")
def sec12_runs_newest_first(spark, sf):
    w = W.partitionBy("document_id").orderBy(F.desc_nulls_last("read_at"), F.desc("page_read_id"))
    return _page_runs(spark, sf).select("page_read_id", "document_id", F.row_number().over(w).cast("bigint").alias("place"))


ORACLE["sec12_runs_newest_first"] = ORACLE["sec12_runs_newest_first"].replace("read_at DESC,", "read_at DESC NULLS LAST,")


@query(f"WITH {_P} SELECT document_id, count(*) + 1 AS next_run FROM p GROUP BY 1")
def agg25_next_run(spark, sf):
    numbered = _page_runs(spark, sf).withColumn("run", F.row_number().over(W.partitionBy("document_id").orderBy("read_at", "page_read_id")))
    return numbered.groupBy("document_id").agg((F.max("run") + 1).cast("bigint").alias("next_run"))


@query("SELECT outcome_id, case_id, printf('F%03d', row_number() OVER (PARTITION BY case_id ORDER BY kind NULLS FIRST, outcome_id)) AS finding FROM (SELECT DISTINCT outcome_id, case_id, kind FROM rule_outcome WHERE case_id IS NOT NULL)")
def win11_finding_ids(spark, sf):
    o = table(spark, sf, "rule_outcome").where("case_id is not null").select("outcome_id", "case_id", "kind").distinct()
    return o.select("outcome_id", "case_id", F.format_string("F%03d", F.row_number().over(W.partitionBy("case_id").orderBy("kind", "outcome_id"))).alias("finding"))


@query("SELECT outcome_id, case_id, row_number() OVER (PARTITION BY case_id ORDER BY head NULLS FIRST, rule_id NULLS FIRST, outcome_id) AS place FROM (SELECT DISTINCT outcome_id, case_id, head, rule_id FROM rule_outcome WHERE outcome IN ('contested', 'unverified') AND case_id IS NOT NULL)")
def srt08_review_queue(spark, sf):
    o = table(spark, sf, "rule_outcome").where("outcome in ('contested', 'unverified') and case_id is not null").select("outcome_id", "case_id", "head", "rule_id").distinct()
    return o.select("outcome_id", "case_id", F.row_number().over(W.partitionBy("case_id").orderBy("head", "rule_id", "outcome_id")).cast("bigint").alias("place"))


# ---------------------------------------------------------------- facts, sums, states

_LI = "li AS (SELECT l_orderkey, l_partkey, l_returnflag AS head, cast(round(l_extendedprice * 100) AS BIGINT) AS paise FROM lineitem)"


def _lineitems(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", F.col("l_returnflag").alias("head"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("paise"))


@query(f"WITH {_LI} SELECT l_orderkey, coalesce(sum(CASE WHEN head IN ('A', 'R') THEN paise END), 0)::BIGINT AS inside, sum(paise)::BIGINT AS whole FROM li GROUP BY 1")
def agg01_category_sums(spark, sf):
    return _lineitems(spark, sf).groupBy("l_orderkey").agg(F.coalesce(F.sum(F.when(F.col("head").isin("A", "R"), F.col("paise"))), F.lit(0)).alias("inside"), F.sum("paise").alias("whole"))


@query(f"WITH {_LI}, d AS (SELECT l_orderkey, sum(CASE WHEN head = 'R' THEN paise ELSE 0 END)::BIGINT AS deducted, sum(paise)::BIGINT AS claimed FROM li GROUP BY 1) SELECT l_orderkey, deducted, claimed - deducted - (claimed * 4 // 5) AS residual FROM d")
def agg05_residuals(spark, sf):
    """What a claim less its deductions and what was paid (four fifths) leaves unexplained."""
    d = _lineitems(spark, sf).groupBy("l_orderkey").agg(F.sum(F.when(F.col("head") == "R", F.col("paise")).otherwise(0)).alias("deducted"), F.sum("paise").alias("claimed"))
    return d.select("l_orderkey", "deducted", (F.col("claimed") - F.col("deducted") - F.floor(F.col("claimed") * 4 / 5)).cast("bigint").alias("residual"))


@query(f"WITH {_LI}, i AS (SELECT p_partkey, unnest(list_filter(['ring', 'small', 'red'], lambda w: contains(' ' || p_name || ' ', ' ' || w || ' '))) AS item FROM part) SELECT l_orderkey, sum(paise)::BIGINT AS excluded, array_to_string(list_sort(list_distinct(list(item))), ' ') AS items FROM li JOIN i ON l_partkey = p_partkey GROUP BY 1")
def agg06_item_totals(spark, sf):
    """Totals of lines whose part has a listed word; a line with two of them counts twice."""
    words = F.array(*map(F.lit, ("ring", "small", "red")))
    i = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.explode(F.filter(words, lambda w: F.concat(F.lit(" "), "p_name", F.lit(" ")).contains(F.concat(F.lit(" "), w, F.lit(" "))))).alias("item"))
    j = salted_join(_lineitems(spark, sf), i, "l_partkey")
    return j.groupBy("l_orderkey").agg(F.sum("paise").alias("excluded"), F.array_join(F.array_sort(F.collect_set("item")), " ").alias("items"))


_RANK = "CASE outcome WHEN 'applies' THEN 0 WHEN 'not_applicable' THEN 0 WHEN 'contested' THEN 2 ELSE 1 END"


@query(f"SELECT case_id, head, max({_RANK}) AS severity, max_by(outcome, ({_RANK}, outcome)) AS worst FROM rule_outcome WHERE case_id IS NOT NULL AND head IS NOT NULL AND outcome IS NOT NULL GROUP BY 1, 2")
def agg09_worst_per_head(spark, sf):
    rank = F.when(F.col("outcome").isin("applies", "not_applicable"), 0).when(F.col("outcome") == "contested", 2).otherwise(1)
    o = table(spark, sf, "rule_outcome").where("case_id is not null and head is not null and outcome is not null")
    return o.groupBy("case_id", "head").agg(F.max(rank).alias("severity"), F.max_by("outcome", F.struct(rank, "outcome")).alias("worst"))


@query(f"WITH c AS (SELECT DISTINCT case_id FROM documents WHERE case_id IS NOT NULL), w AS (SELECT case_id, max({_RANK}) AS s FROM rule_outcome WHERE head IS NOT NULL AND outcome IS NOT NULL GROUP BY 1) SELECT case_id, CASE s WHEN 0 THEN 'CONSISTENT' WHEN 2 THEN 'POTENTIALLY_INCONSISTENT' ELSE 'UNDETERMINED' END AS state FROM c LEFT JOIN w USING (case_id)")
def agg10_worst_state(spark, sf):
    """A case without any outcome is undetermined."""
    rank = F.when(F.col("outcome").isin("applies", "not_applicable"), 0).when(F.col("outcome") == "contested", 2).otherwise(1)
    w = table(spark, sf, "rule_outcome").where("head is not null and outcome is not null").groupBy("case_id").agg(F.max(rank).alias("s"))
    c = table(spark, sf, "documents").where("case_id is not null").select("case_id").distinct()
    return c.join(w, "case_id", "left").select("case_id", F.when(F.col("s") == 0, "CONSISTENT").when(F.col("s") == 2, "POTENTIALLY_INCONSISTENT").otherwise("UNDETERMINED").alias("state"))


_READ = "r AS (SELECT doc_id, sum(CASE WHEN doc_id % 7 = 0 THEN NULL ELSE n_chars END) AS a, sum(CASE WHEN doc_id % 5 = 0 THEN n_chars + 1 WHEN doc_id % 3 = 0 THEN NULL ELSE n_chars END) AS b FROM documents GROUP BY 1), g AS (SELECT doc_id, CASE WHEN a IS NULL AND b IS NULL THEN 'no_reading' WHEN a <> b THEN 'disagree' WHEN a IS NULL OR b IS NULL THEN 'one_reader' ELSE 'agree' END AS agreement FROM r)"


def _readings(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    a = d.select(F.col("doc_id").alias("subject"), F.lit("a").alias("reader"), F.when(F.col("doc_id") % 7 != 0, F.col("n_chars")).alias("paise"))
    b = d.select(F.col("doc_id").alias("subject"), F.lit("b").alias("reader"), F.when(F.col("doc_id") % 5 == 0, F.col("n_chars") + 1).when(F.col("doc_id") % 3 != 0, F.col("n_chars")).alias("paise"))
    return agreement(a.unionByName(b))


@query(f"WITH {_READ} SELECT agreement, count(*) AS facts FROM g WHERE agreement <> 'agree' GROUP BY 1")
def agg19_quarantine(spark, sf):
    """Facts not released, by how their two readings compare."""
    return _readings(spark, sf).where("disposition <> 'USABLE'").groupBy("agreement").agg(F.count(F.lit(1)).alias("facts"))


@query(f"WITH {_READ}, x AS (SELECT unnest(['USABLE', 'QUARANTINED', 'EVIDENCE_GAP', 'REVIEWED']) AS disposition), n AS (SELECT CASE agreement WHEN 'agree' THEN 'USABLE' WHEN 'no_reading' THEN 'EVIDENCE_GAP' ELSE 'QUARANTINED' END AS disposition, count(*) AS facts, min(doc_id) AS first FROM g GROUP BY 1) SELECT disposition, coalesce(facts, 0) AS facts, first FROM x LEFT JOIN n USING (disposition)")
def agg20_partition(spark, sf):
    """Facts by disposition, the empty ones too."""
    kinds = spark.createDataFrame([(x,) for x in ("USABLE", "QUARANTINED", "EVIDENCE_GAP", "REVIEWED")], "disposition string")
    n = _readings(spark, sf).groupBy("disposition").agg(F.count(F.lit(1)).alias("facts"), F.min("subject").alias("first"))
    return kinds.join(n, "disposition", "left").select("disposition", F.coalesce("facts", F.lit(0)).alias("facts"), "first")


@query(f"WITH {_READ} SELECT r.doc_id, CASE WHEN agreement = 'agree' THEN a END::BIGINT AS value FROM r JOIN g USING (doc_id)")
def prd13_usable_values(spark, sf):
    """The value of a fact that may be used, null for any other."""
    return _readings(spark, sf).select(F.col("subject").alias("doc_id"), F.when(F.col("disposition") == "USABLE", F.col("paise")).alias("value"))


@query("SELECT DISTINCT outcome_id, rule_id, outcome, length(quote) AS quote_chars, sha256(quote) AS quote_hash FROM rule_outcome")
def prd16_safe_projection(spark, sf):
    """Results without any text of the sources."""
    return table(spark, sf, "rule_outcome").select("outcome_id", "rule_id", "outcome", F.length("quote").cast("bigint").alias("quote_chars"), F.sha2("quote", 256).alias("quote_hash")).distinct()


@query("SELECT case_id, min_by(outcome_id, (loaded_at, outcome_id)) AS outcome_id FROM rule_outcome WHERE case_id IS NOT NULL AND loaded_at IS NOT NULL AND (contains(lower(head), 'room') OR contains(lower(title), 'room')) GROUP BY 1")
def prd18_first_with_key(spark, sf):
    """The first outcome of a case whose head or title has a word."""
    o = table(spark, sf, "rule_outcome").where("case_id is not null and loaded_at is not null").where(F.lower("head").contains("room") | F.lower("title").contains("room"))
    return o.groupBy("case_id").agg(F.min_by("outcome_id", F.struct("loaded_at", "outcome_id")).alias("outcome_id"))


@query("SELECT DISTINCT clause_id FROM policy_clause WHERE contains(lower(original_text), 'pro rata') OR contains(lower(original_text), 'proportion')")
def jon10_scope_clauses(spark, sf):
    t = F.lower("original_text")
    return table(spark, sf, "policy_clause").where(t.contains("pro rata") | t.contains("proportion")).select("clause_id").distinct()


@query("""WITH c AS (SELECT DISTINCT finding_id, citation_id, ref_type, lower(trim(ref_id)) AS k, quote, loaded_at FROM citation WHERE finding_id IS NOT NULL), l AS (SELECT finding_id, ref_type, max_by(struct_pack(citation_id := citation_id, k := k, quote := quote), (loaded_at, citation_id)) AS x FROM c WHERE loaded_at IS NOT NULL GROUP BY 1, 2),
 t AS (SELECT lower(trim(clause_id)) AS k, max(original_text) AS t, count(*) AS n FROM policy_clause GROUP BY 1)
 SELECT l.finding_id, l.x.citation_id AS citation_id, CASE WHEN t.k IS NULL THEN 'RECORD_MISSING' WHEN t.t IS NULL THEN 'NO_TEXT' WHEN coalesce(l.x.quote, '') = '' THEN 'NO_QUOTE' WHEN contains(t.t, l.x.quote) THEN 'VALID' ELSE 'EVIDENCE_CHANGED' END AS reason FROM l LEFT JOIN t ON l.x.k = t.k WHERE l.ref_type = 'policy_clause'""")
def jon09_effective_values(spark, sf):
    """The latest citation of each finding against the record it names: the first reason that holds."""
    key = lambda c: F.lower(F.trim(c))
    c = table(spark, sf, "citation").where("finding_id is not null and loaded_at is not null and ref_type = 'policy_clause'").select("finding_id", "loaded_at", "citation_id", key("ref_id").alias("k"), "quote").distinct()
    last = latest(c, ["finding_id"], ["loaded_at", "citation_id"])
    t = table(spark, sf, "policy_clause").groupBy(key("clause_id").alias("k")).agg(F.max("original_text").alias("t"), F.lit(True).alias("there"))
    found = salted_join(last, t.where("k is not null"), "k")
    lost = last.join(t.select("k"), "k", "left_anti").withColumn("t", F.lit(None).cast("string")).withColumn("there", F.lit(None).cast("boolean"))
    reason = F.when(F.col("there").isNull(), "RECORD_MISSING").when(F.col("t").isNull(), "NO_TEXT").when(F.coalesce("quote", F.lit("")) == "", "NO_QUOTE").when(F.col("t").contains(F.col("quote")), "VALID").otherwise("EVIDENCE_CHANGED")
    return found.select("finding_id", "citation_id", reason.alias("reason")).unionByName(lost.select("finding_id", "citation_id", reason.alias("reason")))


# ---------------------------------------------------------------- sets and links

_HEADS = ("room", "nursing", "surgeon", "icu", "pharmacy", "implants")
_BIT = "list_filter(['room', 'nursing', 'surgeon', 'icu', 'pharmacy', 'implants'], lambda h, i: ({n} // (1 << (i - 1))::INT) % 2 = 1)"


@query(f"""WITH h AS (SELECT DISTINCT o_orderkey, {_BIT.format(n='(o_orderkey % 64)')} AS applied, {_BIT.format(n='(o_custkey % 64)')} AS defined FROM orders),
 s AS (SELECT *, list_filter(applied, lambda x: len(defined) > 0 AND NOT list_contains(defined, x)) AS outside, list_filter(applied, lambda x: x IN ('icu', 'pharmacy', 'implants')) AS barred FROM h)
 SELECT o_orderkey, array_to_string(outside, ' ') AS outside, array_to_string(barred, ' ') AS barred, array_to_string(list_filter(applied, lambda x: NOT list_contains(outside, x) AND NOT list_contains(barred, x)), ' ') AS allowed, array_to_string(list_transform(applied, lambda x: x || ':' || concat_ws('+', CASE WHEN list_contains(barred, x) THEN CASE WHEN x = 'icu' THEN 'ICU_BARRED' ELSE 'EXCLUDED' END END, CASE WHEN list_contains(outside, x) THEN 'NOT_DEFINED' WHEN len(defined) = 0 THEN 'NOTHING_DEFINED' END)), ' ') AS reasons FROM s""")
def set03_scope_check(spark, sf):
    """Heads a ratio was applied to against those defined and those barred: outside, barred, allowed, and why. Order is kept."""
    heads = F.array(*map(F.lit, _HEADS))
    bits = lambda n: F.filter(heads, lambda h, i: F.floor(F.col(n) % 64 / F.pow(F.lit(2), i)) % 2 == 1)
    h = table(spark, sf, "orders").select("o_orderkey", bits("o_orderkey").alias("applied"), bits("o_custkey").alias("defined")).distinct()
    return lk.scope_check(h, "applied", "defined", F.array(*[F.lit(x) for x in ("icu", "pharmacy", "implants")])).select(
        "o_orderkey", *[F.array_join(c, " ").alias(c) for c in ("outside", "barred", "allowed", "reasons")]
    )


@query("""WITH o AS (SELECT DISTINCT outcome_id, case_id, outcome, quote, citation FROM rule_outcome), f AS (SELECT 1 AS section, outcome_id, case_id FROM o WHERE outcome = 'applies' UNION ALL SELECT 2, outcome_id, case_id FROM o WHERE outcome = 'contested' UNION ALL SELECT 3, outcome_id, case_id FROM o WHERE outcome = 'unverified' UNION ALL SELECT 4, outcome_id, case_id FROM o WHERE quote IS NULL)
 SELECT section, outcome_id, case_id FROM f""")
def set04_sections(spark, sf):
    """One list of several sections, each with its number; a row can be in two."""
    o = table(spark, sf, "rule_outcome").select("outcome_id", "case_id", "outcome", "quote", "citation").distinct()
    of = lambda n, cond: F.when(cond, F.lit(n))
    found = F.array_compact(F.array(of(1, F.col("outcome") == "applies"), of(2, F.col("outcome") == "contested"), of(3, F.col("outcome") == "unverified"), of(4, F.col("quote").isNull())))
    return o.select(F.explode(found).alias("section"), "outcome_id", "case_id")


@query("SELECT outcome_id, CASE WHEN quote IS NOT NULL AND citation IS NOT NULL AND instrument_ref IS NOT NULL AND trim(quote) <> '' THEN 'displayed' ELSE 'withheld' END AS shown FROM (SELECT DISTINCT outcome_id, quote, citation, instrument_ref FROM rule_outcome)")
def set05_displayed_or_withheld(spark, sf):
    full = F.col("quote").isNotNull() & F.col("citation").isNotNull() & F.col("instrument_ref").isNotNull() & (F.trim("quote") != "")
    return table(spark, sf, "rule_outcome").select("outcome_id", "quote", "citation", "instrument_ref").distinct().select("outcome_id", F.when(full, "displayed").otherwise("withheld").alias("shown"))


_L = r"""l AS (SELECT DISTINCT link_id, rule_id, rule_version, rule_status, effect, instrument_ref, quote, assertable, source_ref.corpus_document_id AS doc, lower(trim(source_ref.clause_id)) AS ref FROM rule_link),
 d AS (SELECT corpus_document_id AS doc, max(regexp_replace(lower(reference), '[^a-z0-9]', '', 'g')) AS b FROM corpus_document GROUP BY 1), s AS (SELECT lower(trim(corpus_document_id || '#' || label)) AS ref, min(corpus_document_id) AS owner, min(anchor) AS anchor FROM clause_spec WHERE corpus_document_id IS NOT NULL AND label IS NOT NULL GROUP BY 1),
 k AS (SELECT l.*, doc IS NOT NULL AND l.ref IS NOT NULL AS linked, d.doc IS NOT NULL AS has_doc, s.ref IS NOT NULL AS has_clause, coalesce(owner <> l.doc, FALSE) AS elsewhere, regexp_replace(lower(instrument_ref), '[^a-z0-9]', '', 'g') AS a, d.b, s.anchor FROM l LEFT JOIN d USING (doc) LEFT JOIN s USING (ref)),
 f AS (SELECT *, linked AND has_doc AND has_clause AS resolved, has_doc AND coalesce(b <> '' AND (contains(b, a) OR contains(a, b)), FALSE) AS agrees, CASE WHEN has_clause AND trim(coalesce(quote, '')) <> '' THEN coalesce(contains(quote, anchor) OR contains(anchor, quote), FALSE) END AS verified FROM k),
 p AS (SELECT *, concat_ws('; ', CASE WHEN NOT linked THEN 'no source declared' END, CASE WHEN linked AND NOT has_doc THEN 'document missing' END, CASE WHEN linked AND NOT has_clause THEN 'clause missing' END, CASE WHEN linked AND has_doc AND has_clause AND elsewhere THEN 'clause of another document' END, CASE WHEN verified = FALSE THEN 'quote not in the clause' END, CASE WHEN has_clause AND trim(coalesce(quote, '')) = '' AND rule_status = 'verified' THEN 'quote required' END) AS problems FROM f),
 r AS (SELECT *, resolved AND agrees AND coalesce(verified, TRUE) AND problems = '' AS ok FROM p)"""


@query(f"WITH {_L} SELECT link_id, resolved, agrees, verified, problems, ok FROM r")
def cor09_link_rules(spark, sf):
    """Every rule link resolved: document, clause, instrument, quote; with all that is wrong."""
    r = lk.link_rules(*[table(spark, sf, n) for n in ("rule_link", "clause_spec", "corpus_document")])
    return r.select("link_id", "resolved", "agrees", "verified", "problems", "ok")


@query(f"""WITH {_L} SELECT count(*) AS rules, count_if(linked) AS linked, count_if(resolved) AS resolved, count_if(verified) AS quote_verified, count_if(verified = FALSE) AS quote_failed, count_if(NOT linked) AS unlinked, count_if(linked AND NOT resolved) AS unresolved,
 count_if(resolved AND NOT agrees) AS instrument_mismatched, count_if(assertable) AS assertable, count_if(assertable AND effect IN ('bars_reduction', 'caps') AND NOT ok) AS risky, count_if(ok) AS ok, count(DISTINCT rule_id) AS rule_ids, count_if(rule_status = 'contested') AS contested, count_if(rule_status = 'unverified') AS unverified FROM r""")
def agg12_link_counters(spark, sf):
    """The fourteen counters of a link report."""
    r = lk.link_rules(*[table(spark, sf, n) for n in ("rule_link", "clause_spec", "corpus_document")])
    n = lambda c: F.count_if(c)
    c = F.col
    return r.agg(
        F.count(F.lit(1)).alias("rules"), n(c("linked")).alias("linked"), n(c("resolved")).alias("resolved"), n(c("verified")).alias("quote_verified"), n(~c("verified")).alias("quote_failed"), n(~c("linked")).alias("unlinked"), n(c("linked") & ~c("resolved")).alias("unresolved"),
        n(c("resolved") & ~c("agrees")).alias("instrument_mismatched"), n(c("assertable")).alias("assertable"), n(c("assertable") & c("effect").isin("bars_reduction", "caps") & ~c("ok")).alias("risky"), n(c("ok")).alias("ok"), F.countDistinct("rule_id").alias("rule_ids"), n(c("rule_status") == "contested").alias("contested"), n(c("rule_status") == "unverified").alias("unverified"),
    )


@query(f"WITH {_L}, x AS (SELECT link_id, unnest(list_filter([CASE WHEN NOT linked THEN 'unlinked' END, CASE WHEN linked AND NOT resolved THEN 'unresolved' END, CASE WHEN verified = FALSE THEN 'quote_failure' END, CASE WHEN resolved AND NOT agrees THEN 'instrument_mismatch' END, CASE WHEN assertable AND effect IN ('bars_reduction', 'caps') AND NOT ok THEN 'risky' END], lambda v: v IS NOT NULL)) AS subset FROM r) SELECT link_id, subset FROM x")
def set07_link_subsets(spark, sf):
    r = lk.link_rules(*[table(spark, sf, n) for n in ("rule_link", "clause_spec", "corpus_document")])
    c = F.col
    of = F.array_compact(F.array(F.when(~c("linked"), "unlinked"), F.when(c("linked") & ~c("resolved"), "unresolved"), F.when(~c("verified"), "quote_failure"), F.when(c("resolved") & ~c("agrees"), "instrument_mismatch"), F.when(c("assertable") & c("effect").isin("bars_reduction", "caps") & ~c("ok"), "risky")))
    return r.select("link_id", F.explode(of).alias("subset"))


@query(f"WITH {_L} SELECT link_id, rule_id || ' v' || rule_version || ' [' || rule_status || '] -> ' || CASE WHEN resolved THEN ref ELSE 'no clause' END || CASE WHEN verified IS NULL THEN ' | no quote to verify' WHEN verified THEN ' | quote found' ELSE ' | quote not found' END || CASE WHEN problems <> '' THEN ' | ' || problems ELSE '' END AS provenance FROM r")
def cor11_provenance_text(spark, sf):
    r = lk.link_rules(*[table(spark, sf, n) for n in ("rule_link", "clause_spec", "corpus_document")])
    c = F.col
    text = F.concat(c("rule_id"), F.lit(" v"), c("rule_version").cast("string"), F.lit(" ["), c("rule_status"), F.lit("] -> "), F.when(c("resolved"), c("ref")).otherwise("no clause"), F.when(c("verified").isNull(), " | no quote to verify").when(c("verified"), " | quote found").otherwise(" | quote not found"), F.when(c("problems") != "", F.concat(F.lit(" | "), c("problems"))).otherwise(""))
    return r.select("link_id", text.alias("provenance"))


# ---------------------------------------------------------------- corpus

_TEXT = "(SELECT DISTINCT ON (page_read_id) page_read_id, document_id, page_number, layout.text AS t FROM page_read WHERE layout.text IS NOT NULL)"
_SPEC = "(SELECT DISTINCT corpus_document_id AS document_id, label, anchor, page_number FROM clause_spec WHERE anchor <> '' AND label IS NOT NULL)"


def _specs_on_pages(spark, sf):
    s = table(spark, sf, "clause_spec").where("anchor <> '' and label is not null").select(F.col("corpus_document_id").alias("document_id"), "label", "anchor", "page_number").distinct()
    p = table(spark, sf, "page_read").dropDuplicates(["page_read_id"]).select("page_read_id", "document_id", "page_number", F.col("layout.text").alias("t")).where("t is not null")
    return s, p


@query(f"WITH s AS {_SPEC}, p AS {_TEXT}, n AS (SELECT s.document_id, label, anchor, sum((length(t) - length(replace(t, anchor, ''))) // length(anchor)) AS n FROM s JOIN p ON s.document_id = p.document_id AND s.page_number = p.page_number GROUP BY 1, 2, 3) SELECT document_id, label, anchor, CASE WHEN n = 0 THEN 'not found' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS located FROM n")
def cor01_anchors(spark, sf):
    """Whether an anchor stands exactly once on the page it is declared for."""
    s, p = _specs_on_pages(spark, sf)
    n = s.join(p, ["document_id", "page_number"]).groupBy("document_id", "label", "anchor").agg(F.sum(tx.occurrences(F.col("t"), F.col("anchor"))).alias("n"))
    return n.select("document_id", "label", "anchor", F.when(F.col("n") == 0, "not found").when(F.col("n") > 1, "ambiguous").otherwise("ok").alias("located"))


@query("WITH h AS (SELECT page_read_id, t, pos - 1 AS a FROM (SELECT page_read_id, t, unnest(list_filter(range(1, length(t) + 1), lambda i: substr(t, i, 2) = chr(10) || chr(10))) AS pos FROM " + _TEXT + ")), s AS (SELECT page_read_id, a, least(lead(a) OVER (PARTITION BY page_read_id ORDER BY a), length(t)) AS nxt, length(t) AS n FROM h) SELECT page_read_id, a::BIGINT AS starts, coalesce(nxt, n)::BIGINT AS ends FROM s")
def cor02_slice_ends(spark, sf):
    """Paragraph marks of a page: each slice ends where the next one begins, the last one with the page."""
    _, p = _specs_on_pages(spark, sf)
    at = F.filter(F.sequence(F.lit(1), F.length("t")), lambda i: F.substring(F.col("t"), i, F.lit(2)) == "\n\n")
    h = p.where("length(t) > 0").select("page_read_id", F.length("t").alias("n"), F.explode(at).alias("pos"))
    nxt = F.lead("pos").over(W.partitionBy("page_read_id").orderBy("pos"))
    return h.select("page_read_id", (F.col("pos") - 1).cast("bigint").alias("starts"), F.coalesce(nxt - 1, F.col("n")).cast("bigint").alias("ends"))


@query("SELECT corpus_document_id, count(DISTINCT title) AS titles, count(DISTINCT reference) AS references_ FROM (SELECT corpus_document_id, title, reference FROM corpus_document UNION ALL SELECT 'planted', unnest(['A', 'B']), 'R-1') GROUP BY 1 HAVING count(DISTINCT title) > 1 OR count(DISTINCT reference) > 1")
def cor03_conflicting_ids(spark, sf):
    """Ids under which different documents are declared; one such is planted."""
    rows = table(spark, sf, "corpus_document").select("corpus_document_id", "title", "reference").unionByName(spark.createDataFrame([("planted", t, "R-1") for t in "AB"], "corpus_document_id string, title string, reference string"))
    g = rows.groupBy("corpus_document_id").agg(F.countDistinct("title").alias("titles"), F.countDistinct("reference").alias("references_"))
    return g.where("titles > 1 or references_ > 1")


@query("SELECT DISTINCT clause_id, concat_ws('; ', CASE WHEN trim(coalesce(clause_id, '')) = '' THEN 'no id' END, CASE WHEN trim(coalesce(original_text, '')) = '' THEN 'empty text' END, CASE WHEN coalesce(char_end <= char_start, TRUE) THEN 'end not behind start' END, CASE WHEN document_id IS NULL THEN 'no document' END) AS problems FROM policy_clause")
def cor05_clause_problems(spark, sf):
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    p = F.concat_ws("; ", F.when(blank("clause_id"), "no id"), F.when(blank("original_text"), "empty text"), F.when(F.coalesce(F.col("char_end") <= F.col("char_start"), F.lit(True)), "end not behind start"), F.when(F.col("document_id").isNull(), "no document"))
    return table(spark, sf, "policy_clause").select("clause_id", p.alias("problems")).distinct()


@query("WITH m AS (SELECT DISTINCT corpus_document_id, issuer, superseded_by FROM corpus_document), h AS (SELECT corpus_document_id, sha256(concat_ws('|', coalesce(issuer, ''), coalesce(superseded_by, ''))) AS h FROM m) SELECT corpus_document_id, min(h) AS manifest, count(*) = 1 AS stable FROM h GROUP BY 1")
def sec30_manifests_equal(spark, sf):
    """Whether all rows of a document agree apart from their commentary."""
    h = tx.fingerprint(F.col("issuer"), F.col("superseded_by"))
    return table(spark, sf, "corpus_document").select("corpus_document_id", h.alias("h")).distinct().groupBy("corpus_document_id").agg(F.min("h").alias("manifest"), (F.count(F.lit(1)) == 1).alias("stable"))


@query("SELECT document_id, page_number, row_number() OVER (PARTITION BY document_id ORDER BY page_number) AS place FROM (SELECT DISTINCT document_id, page_number FROM page_read)")
def sec32_pages_in_order(spark, sf):
    p = table(spark, sf, "page_read").select("document_id", "page_number").distinct()
    return p.select("document_id", "page_number", F.row_number().over(W.partitionBy("document_id").orderBy("page_number")).cast("bigint").alias("place"))


@query("SELECT uin, min(document_id) AS a, max(document_id) AS b, count(DISTINCT document_id) AS documents FROM (SELECT uin, document_id FROM policy_clause WHERE uin IS NOT NULL UNION ALL SELECT 'TEST-UIN', unnest(['d1', 'd2', 'd2'])) GROUP BY 1 HAVING count(DISTINCT document_id) > 1")
def agg16_identifiers_of_several(spark, sf):
    """Identifiers that more than one document carries; one such is planted."""
    own = table(spark, sf, "policy_clause").where("uin is not null").select("uin", "document_id")
    rows = own.unionByName(spark.createDataFrame([("TEST-UIN", d) for d in ("d1", "d2", "d2")], "uin string, document_id string"))
    return rows.groupBy("uin").agg(F.min("document_id").alias("a"), F.max("document_id").alias("b"), F.countDistinct("document_id").alias("documents")).where("documents > 1")


@query("SELECT content_id, doc_id FROM (SELECT sha256(text) AS content_id, doc_id, count(*) OVER (PARTITION BY sha256(text)) AS n FROM documents WHERE text IS NOT NULL) WHERE n > 1")
def agg16_duplicate_contents(spark, sf):
    """The documents whose content another one has too. A content of very many is salted."""
    d = table(spark, sf, "documents").where("text is not null").select(F.sha2("text", 256).alias("content_id"), "doc_id")
    several = d.groupBy("content_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("content_id")
    return salted_join(d, several, "content_id")
