"""Queries that read pages, bills, letters, wordings and quotes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import bills as bl
from ledgerloom.functions import text as tx
from ledgerloom.operators.geometry import characters_to_lines, words_to_lines
from ledgerloom.plans.reference import _DOCS, with_planted
from ledgerloom.operators.records import text_lines
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


_PAGE = "p AS (SELECT DISTINCT ON (page_read_id) page_read_id, document_id, page_number, layout.text AS t, layout.method AS method, layout.mean_confidence AS conf FROM page_read)"


def _pages(spark, sf) -> DataFrame:
    return table(spark, sf, "page_read").dropDuplicates(["page_read_id"]).select("page_read_id", "document_id", "page_number", F.col("layout.text").alias("t"), F.col("layout.method").alias("method"), F.col("layout.mean_confidence").alias("conf"))


_PLINES = f"{_PAGE}, l AS (SELECT page_read_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS no FROM p WHERE t IS NOT NULL)"


def _page_lines(spark, sf) -> DataFrame:
    return _pages(spark, sf).where("t is not null").select("page_read_id", F.posexplode(F.split("t", "\n")).alias("pos", "line"))


# ---------------------------------------------------------------- geometry


@query(f"WITH {_PLINES}, k AS (SELECT page_read_id, no, trim(regexp_replace(regexp_replace(line, '[ \\t]{{2,}}', ' ', 'g'), '\\t', ' ', 'g')) AS line FROM l) SELECT page_read_id AS page, row_number() OVER (PARTITION BY page_read_id ORDER BY no) AS line_no, line FROM k WHERE line <> ''")
def src04_characters_to_lines(spark, sf):
    """Every character of every page laid out on a grid, blanks left out, and the lines read from the places alone."""
    ls = _page_lines(spark, sf).select("page_read_id", "pos", F.translate("line", "\t", " ").alias("line"))
    c = ls.select(F.col("page_read_id").alias("page"), "pos", F.posexplode(F.split("line", "")).alias("i", "ch")).where("ch <> '' and ch <> ' '")
    x, y = F.col("i") * 6.0, F.col("pos") * -14.0
    return characters_to_lines(c.select("page", "ch", x.alias("x0"), y.alias("y0"), (x + 5.0).alias("x1"), (y + 10.0).alias("y1")))


@query(f"WITH {_PLINES}, w AS (SELECT page_read_id, no, list_filter(string_split_regex(line, '\\s+'), lambda x: x <> '') AS ws FROM l), k AS (SELECT page_read_id, no, ws FROM w WHERE len(ws) > 0) SELECT page_read_id AS page, row_number() OVER (PARTITION BY page_read_id ORDER BY no) AS line_no, array_to_string(ws, ' ') AS line, list_min(list_transform(ws, lambda x, i: (i * 50)::DOUBLE)) AS x0, (1000 - no * 14.0 - 10)::DOUBLE AS y0, round(list_avg(list_transform(ws, lambda x: length(x) * 5 / 100)), 9) AS confidence FROM k")
def src05_words_to_lines(spark, sf):
    """The words of every page as boxes of a reader, put together again."""
    ws = _page_lines(spark, sf).select(F.col("page_read_id").alias("page"), "pos", F.posexplode(F.filter(F.split("line", r"\s+"), lambda x: x != "")).alias("i", "word"))
    boxes = ws.select("page", F.lit(1).alias("block"), F.lit(1).alias("par"), (F.col("pos") + 1).alias("line"), "word", (F.length("word") * 5.0).alias("confidence"), ((F.col("i") + 1) * 50.0).alias("left"), ((F.col("pos") + 1) * 14.0).alias("top"), F.lit(40.0).alias("width"), F.lit(10.0).alias("height"), F.lit(1000.0).alias("page_height"))
    return words_to_lines(boxes).select("page", "line_no", "line", "x0", "y0", F.round("confidence", 9).alias("confidence"))


# ---------------------------------------------------------------- pages and uploads


@query(f"WITH {_PAGE} SELECT page_read_id, concat_ws(' ', CASE WHEN length(coalesce(t, '')) < 12 THEN 'NO_TEXT_LAYER' END, CASE WHEN method = 'ocr' THEN 'OCR_APPLIED' END, CASE WHEN trim(coalesce(t, ''), ' ') = '' THEN 'NO_TEXT' END, CASE WHEN conf < 0.6 THEN 'LOW_OCR_CONFIDENCE' END, CASE WHEN regexp_matches(t, '\\d,\\d{{2}}(?:\\D|$)') THEN 'DECIMAL_COMMA_CANDIDATE' END, CASE WHEN regexp_matches(t, '\\d{{6,}}') THEN 'LONG_DIGIT_RUN' END) AS flags FROM p")
def ing20_page_flags(spark, sf):
    return _pages(spark, sf).select("page_read_id", F.array_join(bl.page_flags(F.col("t"), F.col("method"), F.col("conf")), " ").alias("flags"))


@query(f"WITH {_PAGE} SELECT page_read_id, CASE WHEN trim(coalesce(t, ''), ' ') = '' THEN 0.0 WHEN conf < 0.6 THEN 0.5 ELSE 1.0 END::DOUBLE AS score FROM p")
def sec21_page_scores(spark, sf):
    flags = bl.page_flags(F.col("t"), F.col("method"), F.col("conf"))
    return _pages(spark, sf).withColumn("f", flags).select("page_read_id", F.when(F.array_contains("f", "NO_TEXT"), 0.0).when(F.array_contains("f", "LOW_OCR_CONFIDENCE"), 0.5).otherwise(1.0).alias("score"))


@query(f"WITH {_PAGE}, h AS (SELECT page_read_id, sha256(t) AS h, page_read_id % 4 = 0 AS changed, conf FROM p WHERE t IS NOT NULL) SELECT page_read_id, NOT changed AS intact, CASE WHEN changed THEN 0.0 WHEN conf < 0.6 THEN 0.5 ELSE 1.0 END::DOUBLE AS score FROM h")
def sec18_trusted_pages(spark, sf):
    """Pages against the hashes they were stored with; one in four is given a wrong one."""
    p = _pages(spark, sf).where("t is not null").withColumn("stored", F.when(F.col("page_read_id") % 4 == 0, F.sha2(F.concat("t", F.lit("x")), 256)).otherwise(F.sha2("t", 256)))
    intact = F.sha2("t", 256) == F.col("stored")
    return p.select("page_read_id", intact.alias("intact"), F.when(~intact, 0.0).when(F.col("conf") < 0.6, 0.5).otherwise(1.0).alias("score"))


_UPLOAD = "u AS (SELECT doc_id, coalesce(n_chars, 0) AS bytes, ['a.pdf', 'b.PDF', 'c.txt', 'dir/d.pdf', 'e.pdf'][(doc_id % 5 + 1)::INT] AS name, ['application/pdf', '', 'text/plain', 'application/x-pdf; v=1'][(doc_id % 4 + 1)::INT] AS mime, CASE WHEN doc_id % 7 = 0 THEN 'GIF89a' ELSE '%PDF-1.7 ' END AS head, doc_id % 11 = 0 AS encrypted, (doc_id % 13)::INT * 40 AS pages FROM documents)"


@query(f"WITH {_UPLOAD} SELECT doc_id, CASE WHEN name = 'c.txt' OR mime = 'text/plain' THEN 'UNSUPPORTED_FILE_TYPE' WHEN bytes > 4000 THEN 'UPLOAD_TOO_LARGE' WHEN bytes = 0 OR head <> '%PDF-1.7 ' THEN 'UNSUPPORTED_FILE_TYPE' WHEN encrypted THEN 'ENCRYPTED_PDF' WHEN pages < 1 THEN 'CORRUPT_PDF' WHEN pages > 250 THEN 'PDF_PAGE_LIMIT_EXCEEDED' ELSE 'OK' END AS verdict FROM u")
def src16_upload_check(spark, sf):
    """Uploads made of the documents, with names, types, beginnings, sizes and pages in fixed classes: the first reason to refuse each."""
    from ledgerloom.sources.uploads import upload_verdict

    k = F.col("doc_id")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (k % len(xs) + 1).cast("int"))
    u = table(spark, sf, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("bytes"), pick(["a.pdf", "b.PDF", "c.txt", "dir/d.pdf", "e.pdf"]).alias("name"), pick(["application/pdf", "", "text/plain", "application/x-pdf; v=1"]).alias("mime"), F.when(k % 7 == 0, "GIF89a").otherwise("%PDF-1.7 ").alias("head"), (k % 11 == 0).alias("encrypted"), ((k % 13) * 40).alias("pages"))
    return u.select("doc_id", F.coalesce(upload_verdict(F.col("name"), F.col("mime"), F.col("bytes"), F.col("head"), F.col("encrypted"), F.col("pages"), most_bytes=4000, most_pages=250), F.lit("OK")).alias("verdict"))


@query("SELECT DISTINCT corpus_document_id, title, CASE WHEN s = '' THEN 'upload.pdf' ELSE s END AS name FROM (SELECT corpus_document_id, title, regexp_replace(regexp_replace(regexp_replace(coalesce(title, 'upload.pdf'), '^.*[/\\\\]', ''), '[\\p{C}\\p{Zl}\\p{Zp}]', '_', 'g'), '^[ .]+|[ .]+$', '', 'g') AS s FROM (SELECT corpus_document_id, title FROM corpus_document UNION ALL VALUES ('x1', 'C:\\temp\\bill .pdf. '), ('x2', '../../'), ('x3', NULL)))")
def txt30_safe_names(spark, sf):
    rows = table(spark, sf, "corpus_document").select("corpus_document_id", "title").unionByName(spark.createDataFrame([("x1", "C:\\temp\\bill .pdf. "), ("x2", "../../"), ("x3", None)], "corpus_document_id string, title string"))
    return rows.select("corpus_document_id", "title", tx.safe_filename(F.col("title")).alias("name")).distinct()


@query("SELECT DISTINCT corpus_document_id, upper(coalesce(source_type, 'unknown')) || '-' || substr(sha256(coalesce(title, '')), 1, 12) AS derived_id FROM corpus_document")
def ing23_derived_ids(spark, sf):
    d = table(spark, sf, "corpus_document").select("corpus_document_id", "source_type", "title").distinct()
    return d.select("corpus_document_id", F.concat_ws("-", F.upper(F.coalesce("source_type", F.lit("unknown"))), F.substring(F.sha2(F.coalesce("title", F.lit("")), 256), 1, 12)).alias("derived_id")).distinct()


@query(f"WITH {_PAGE}, h AS (SELECT page_read_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('page|' || page_read_id)) AS h FROM p) SELECT page_read_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr(h, 17, 1))::INT, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS span_key FROM h")
def sec23_span_keys(spark, sf):
    return _pages(spark, sf).select("page_read_id", tx.uuid5_url(F.concat(F.lit("page|"), F.col("page_read_id").cast("string"))).alias("span_key"))


@query("SELECT DISTINCT clause_id, '{\"char_end\":' || coalesce(char_end::VARCHAR, 'null') || ',\"char_start\":' || coalesce(char_start::VARCHAR, 'null') || ',\"clause_id\":\"' || clause_id || '\",\"page_number\":' || coalesce(page_number::VARCHAR, 'null') || '}' AS payload, sha256('{\"char_end\":' || coalesce(char_end::VARCHAR, 'null') || ',\"char_start\":' || coalesce(char_start::VARCHAR, 'null') || ',\"clause_id\":\"' || clause_id || '\",\"page_number\":' || coalesce(page_number::VARCHAR, 'null') || '}') AS payload_hash FROM policy_clause WHERE clause_id IS NOT NULL")
def txt19_payload_hashes(spark, sf):
    """Canonical JSON of a clause's place, and its hash."""
    c = table(spark, sf, "policy_clause").where("clause_id is not null").select("clause_id", "page_number", "char_start", "char_end").distinct()
    payload = tx.canonical_json({k: F.col(k) for k in ("page_number", "clause_id", "char_start", "char_end")})
    return c.select("clause_id", payload.alias("payload"), F.sha2(payload, 256).alias("payload_hash"))


@query("SELECT corpus_document_id, label, CASE WHEN page_number IS NULL THEN 'CL-DECL-' ELSE 'CL-' END || upper(substr(sha256(CASE WHEN page_number IS NULL THEN 'declared|' || corpus_document_id || '|' || label || '|' || coalesce(anchor, '') ELSE concat_ws('|', corpus_document_id, page_number, 0, length(coalesce(anchor, '')), coalesce(anchor, '')) END), 1, 20)) AS clause_address, page_number IS NOT NULL AS located FROM (SELECT DISTINCT corpus_document_id, label, anchor, page_number FROM clause_spec WHERE corpus_document_id IS NOT NULL AND label IS NOT NULL UNION ALL VALUES ('planted', '1', 'text', NULL))")
def txt23_declared_addresses(spark, sf):
    """Clauses by where they stand, or, without a page, by what is declared of them, which is visibly weaker."""
    s = table(spark, sf, "clause_spec").where("corpus_document_id is not null and label is not null").select("corpus_document_id", "label", "anchor", "page_number").distinct()
    s = s.unionByName(spark.createDataFrame([("planted", "1", "text", None)], "corpus_document_id string, label string, anchor string, page_number int"))
    anchor, located = F.coalesce("anchor", F.lit("")), F.col("page_number").isNotNull()
    material = F.when(located, F.concat_ws("|", "corpus_document_id", F.col("page_number").cast("string"), F.lit("0"), F.length(anchor).cast("string"), anchor)).otherwise(F.concat_ws("|", F.lit("declared"), "corpus_document_id", "label", anchor))
    return s.select("corpus_document_id", "label", F.concat(F.when(located, "CL-").otherwise("CL-DECL-"), F.upper(F.substring(F.sha2(material, 256), 1, 20))).alias("clause_address"), located.alias("located"))


# ---------------------------------------------------------------- headings and metadata



def _h(group: int) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(line, '{p}') THEN regexp_extract(line, '{p}', {group})" for p in tx.HEADINGS) + " END"


_HEADS = f"{_PLINES}, o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY page_read_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start FROM l), h AS (SELECT page_read_id, char_start, trim({_h(1)}) AS label, trim({_h(2)}) AS heading FROM o WHERE {_h(1)} IS NOT NULL)"


def _headings(spark, sf) -> DataFrame:
    lines = text_lines(table(spark, sf, "page_read").select("page_read_id", F.col("layout.text").alias("t")), "page_read_id", "t")
    return lines.withColumn("h", tx.heading(F.col("line"))).where("h is not null").select("page_read_id", "char_start", "h.label", "h.heading")


@query(f"WITH {_HEADS} SELECT page_read_id, char_start, label, heading FROM h")
def txt24_all_headings(spark, sf):
    """Headings by all three patterns, with where they stand."""
    return _headings(spark, sf)


@query(f"WITH {_HEADS}, c AS (SELECT h.page_read_id, label, char_start, coalesce(lead(char_start) OVER (PARTITION BY h.page_read_id ORDER BY char_start), length(t)) AS char_end, t FROM h JOIN p ON h.page_read_id = p.page_read_id) SELECT page_read_id, label, char_start, char_end::BIGINT AS char_end FROM c WHERE char_end - char_start >= 80")
def win06_clause_cuts(spark, sf):
    """From each heading to the next; what is shorter than 80 characters is no clause."""
    nxt = F.lead("char_start").over(W.partitionBy("page_read_id").orderBy("char_start"))
    size = _pages(spark, sf).select("page_read_id", F.length("t").cast("bigint").alias("n"))
    c = _headings(spark, sf).withColumn("nxt", nxt).join(size, "page_read_id")
    return c.select("page_read_id", "label", "char_start", F.coalesce("nxt", "n").alias("char_end")).where("char_end - char_start >= 80")


@query(f"WITH {_HEADS}, g AS (SELECT p.page_read_id, count(label) AS n, coalesce(bool_and(regexp_full_match(label, '[IVXLC]+')), FALSE) AS roman, coalesce(bool_and(starts_with(lower(label), 'section')), FALSE) AS sectioned, coalesce(bool_or(regexp_matches(label, '^\\d')), FALSE) AS numbered FROM p LEFT JOIN h ON p.page_read_id = h.page_read_id GROUP BY 1) SELECT page_read_id, n AS headings, CASE WHEN n = 0 THEN 'page-cut' WHEN roman THEN 'roman' WHEN sectioned THEN 'sectioned' WHEN numbered THEN 'numbered' ELSE 'unknown' END AS structure FROM g")
def ing11_structures(spark, sf):
    label = F.col("label")
    g = _pages(spark, sf).select("page_read_id").join(_headings(spark, sf).select("page_read_id", "label"), "page_read_id", "left").groupBy("page_read_id").agg(
        F.count("label").alias("headings"), F.every(label.rlike("^[IVXLC]+$")).alias("roman"), F.every(F.lower(label).startswith("section")).alias("sectioned"), F.some(label.rlike(r"^\d")).alias("numbered")
    )
    return g.select("page_read_id", "headings", F.when(F.col("headings") == 0, "page-cut").when(F.col("roman"), "roman").when(F.col("sectioned"), "sectioned").when(F.col("numbered"), "numbered").otherwise("unknown").alias("structure"))


_LETTERS = (
    "Claimed amount Rs 1,25,000.50\nFinal payable amount: Rs 98,000\nDeducted towards room rent Rs 2,000.00", "Total bill amount 5,400\nNet payable INR 4,100.25\nConsumables deducted 300.00", "POLICY SCHEDULE\nPolicy number 12\nSum insured Rs 5,00,000\nRoom rent limit 1%\nCo-payment of 20%",
    "policy schedule sum insured 300000 room rent Rs 4,500 icu", "UIN: ABCHLIP21001V022021\nEffective from 01/04/2022\nPolicy period 01/04/2022 to 31/03/2023", "Valid from 5-Jan-2021 UIN NIAHLGP22002V012122", "Policy wordings. coverage and exclusions", "Master circular of the regulations", "Interim bill of supply", "claim form", "the claim decision was settled", "",
)
_T = "docs AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-k}, '{t}')" for k, t in enumerate(_LETTERS, 1)) + ") v(doc_id, text)), t AS (SELECT * FROM docs WHERE text IS NOT NULL)"


def _texts(spark, sf) -> DataFrame:
    """doc_id, text of the documents and of a few letters, schedules and wordings with negative ids."""
    return table(spark, sf, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(-k, t) for k, t in enumerate(_LETTERS, 1)], "doc_id bigint, text string")).where("text is not null")


def _sql_paise(a: str) -> str:
    whole = f"cast(replace(regexp_extract({a}, '^([\\d,]+)', 1), ',', '') AS BIGINT) * 100"
    return f"CASE WHEN regexp_matches({a}, '^\\d') THEN {whole} + cast(rpad(regexp_extract({a}, '\\.(\\d+)$', 1), 2, '0') AS BIGINT) END"


def _sql_first(*patterns: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_replace(regexp_extract(text, '{p}', 1), '^,+|,+$', '', 'g'), '')" for p in patterns) + ")"


@query(f"WITH {_T}, a AS (SELECT doc_id, {_sql_first(bl.CLAIMED)} AS c, {_sql_first(bl.PAYABLE, bl.NET_PAYABLE)} AS p FROM t) SELECT doc_id, {_sql_paise('c')} AS claimed, {_sql_paise('p')} AS payable FROM a WHERE c IS NOT NULL OR p IS NOT NULL")
def ing09_letter_amounts(spark, sf):
    """What a letter says was claimed and is paid."""
    t = _texts(spark, sf).select("doc_id", bl.first_paise(F.col("text"), bl.CLAIMED).alias("claimed"), bl.first_paise(F.col("text"), bl.PAYABLE, bl.NET_PAYABLE).alias("payable"))
    return t.where("claimed is not null or payable is not null")


@query(f"WITH {_T}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM t) SELECT doc_id, line_no, 'SF-' || upper(substr(sha256(doc_id || '|' || line_no || '|' || line), 1, 16)) AS line_id FROM l WHERE regexp_matches(line, '{bl.LETTER_WORDS}') AND regexp_matches(line, '\\d')")
def ing09_letter_lines(spark, sf):
    """Lines that speak of settling, with a number."""
    ls = _texts(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.col("line").rlike(bl.LETTER_WORDS) & F.col("line").rlike(r"\d"))
    no = (F.col("pos") + 1).cast("bigint")
    return ls.select("doc_id", no.alias("line_no"), F.concat(F.lit("SF-"), F.upper(F.substring(F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), no.cast("string"), "line"), 256), 1, 16))).alias("line_id"))


@query(f"WITH {_T}, a AS (SELECT doc_id, nullif(regexp_replace(regexp_extract(text, '{bl.INSURED}', 1), ',', '', 'g'), '') AS si, nullif(regexp_replace(regexp_extract(text, '{bl.ROOM_RENT}', 1), ',', '', 'g'), '') AS rr, nullif(regexp_extract(text, '{bl.CO_PAY}', 1), '') AS cp FROM t), b AS (SELECT doc_id, try_cast(si AS HUGEINT) * 100 AS si, rr, try_cast(regexp_extract(rr, '^(\\d+)', 1) AS HUGEINT) AS n, try_cast(cp AS INT) AS cp FROM a) SELECT doc_id, si::BIGINT AS sum_insured, CASE WHEN regexp_matches(rr, '(?i)%|percent') THEN si * n // 100 ELSE n * 100 END::BIGINT AS room_rent_limit, cp AS co_pay_percent FROM b WHERE si IS NOT NULL OR rr IS NOT NULL OR cp IS NOT NULL")
def ing18_schedule_fields(spark, sf):
    """Sum insured, room rent, absolute or as a percentage of it, and co-payment, in exact integers."""
    get = lambda p: F.nullif(F.regexp_replace(F.regexp_extract("text", p, 1), ",", ""), F.lit(""))
    a = _texts(spark, sf).select("doc_id", (get(bl.INSURED).try_cast("bigint") * 100).alias("si"), get(bl.ROOM_RENT).alias("rr"), get(bl.CO_PAY).try_cast("int").alias("cp")).where("si is not null or rr is not null or cp is not null")
    n = F.regexp_extract("rr", r"^(\d+)", 1).try_cast("bigint")
    return a.select("doc_id", F.col("si").alias("sum_insured"), F.when(F.col("rr").rlike(r"(?i)%|percent"), F.floor((F.col("si").cast("decimal(38,0)") * n).cast("decimal(38,0)") / 100).cast("bigint")).otherwise(n * 100).alias("room_rent_limit"), F.col("cp").alias("co_pay_percent"))


@query(f"WITH {_T} SELECT doc_id, upper(coalesce(nullif(regexp_extract(text, '{bl.UIN}', 1), ''), nullif(regexp_extract(text, '{bl.UIN_LABELLED}', 1), ''))) AS uin, nullif(trim(regexp_extract(text, '{bl.EFFECTIVE}', 1)), '') AS effective, nullif(regexp_extract(text, '{bl.PERIOD}', 1), '') AS period_from, nullif(regexp_extract(text, '{bl.PERIOD}', 2), '') AS period_to FROM t")
def ing10_metadata(spark, sf):
    get = lambda p, k=1: F.nullif(F.regexp_extract("text", p, k), F.lit(""))
    return _texts(spark, sf).select("doc_id", F.upper(F.coalesce(get(bl.UIN), get(bl.UIN_LABELLED))).alias("uin"), F.trim(get(bl.EFFECTIVE)).alias("effective"), get(bl.PERIOD).alias("period_from"), get(bl.PERIOD, 2).alias("period_to"))


_TYPE = "CASE WHEN contains(lower(text), 'policy wording') OR contains(lower(text), 'uin') AND contains(lower(text), 'schedule') THEN 'policy_wording' " + " ".join(f"WHEN contains(lower(text), '{w}') THEN '{t}'" for t, w in bl.DOCUMENT_TYPES[1:]) + " ELSE 'unknown' END"
_SCORE = lambda ws: " + ".join(f"contains(lower(text), '{w}')::INT" for w in ws)


@query(f"WITH {_T}, k AS (SELECT *, {_TYPE} AS kind, {_SCORE(bl.SCHEDULE_WORDS)} AS s, {_SCORE(bl.WORDING_WORDS)} AS w FROM t) SELECT doc_id, kind, CASE WHEN kind = 'hospital_bill' THEN 'bill' WHEN kind = 'policy_wording' THEN CASE WHEN s > w AND s > 0 THEN 'policy_schedule' ELSE 'policy_wording' END WHEN kind = 'unknown' AND regexp_matches(text, '{bl.DECISION}') THEN 'settlement' END AS role, CASE kind WHEN 'hospital_bill' THEN 'PRESENT' WHEN 'policy_wording' THEN 'NONE' WHEN 'regulation' THEN 'NONE' ELSE 'UNKNOWN' END AS pii FROM k")
def ing13_types_and_roles(spark, sf):
    """The type of a document, the role its words propose, and whether its kind holds personal data."""
    k = _texts(spark, sf).select("doc_id", bl.document_type(F.col("text")).alias("kind"), bl.role_proposal(F.col("text")).alias("role"))
    return k.select("*", F.when(F.col("kind") == "hospital_bill", "PRESENT").when(F.col("kind").isin("policy_wording", "regulation"), "NONE").otherwise("UNKNOWN").alias("pii"))


# ---------------------------------------------------------------- bills

_PRINTED = (
    "1. 12/04/2024 Room rent 2,000.00 x 3 6,000.00", "Sub total 6,000.00", "Grand Total 12,500.00", "Net amount payable 9,000.00", "Service amount 2,20,976.30", "ADVANCE RECEIVED 500.00", "999311", "Department 999316", "Pharmacy MED12AB paracetamol tab 12.50", "OT charges 350,00", "12 Apr 2024 consultation visit", "Surgeon fee 15,000.00", "After discount 800.00", "CBC test 450.00 x 2 900.00", "ambulance", "Total of ward charges 4,000.00", "",
)
_B = "docs AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1, '" + "' || chr(10) || '".join(_PRINTED) + "'), b AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM docs WHERE text IS NOT NULL)"
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(line, '{p}') THEN '{k}'" for k, p in bl.SUMMARY_KINDS.items()) + " END"


def _bill_lines(spark, sf) -> DataFrame:
    """doc_id, line_no, line of the documents and of one printed bill."""
    d = table(spark, sf, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, "\n".join(_PRINTED))], "doc_id bigint, text string"))
    return d.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", (F.col("pos") + 1).cast("bigint").alias("line_no"), "line")


@query(f"WITH {_B} SELECT doc_id, line_no, {_KIND} AS kind FROM b WHERE {_KIND} IS NOT NULL")
def ing05_summary_kinds(spark, sf):
    return _bill_lines(spark, sf).select("doc_id", "line_no", bl.summary_kind(F.col("line")).alias("kind")).where("kind is not null")


_MONEY = r"m AS (SELECT *, regexp_extract_all(line, '\d[\d,]*(?:\.\d{1,2})?|\d[\d.]*,\d{1,2}') AS a, regexp_extract_all(line, '\d[\d,]*\.\d{2}') AS s FROM b), q AS (SELECT *, nullif(regexp_extract(line, '[xX×]\s*(\d+(?:\.\d+)?)', 1), '') AS qty, regexp_extract_all(regexp_extract(line, '^(.*?)[xX×]\s*\d', 1), '\d[\d,]*(?:\.\d{1,2})?|\d[\d.]*,\d{1,2}') AS before FROM m)"
_RATE = "qty IS NOT NULL AND len(before) > 0 AND (regexp_full_match(before[len(before)], '\\d+') OR regexp_full_match(before[len(before)], '\\d{1,3}(,\\d{2,3})+') OR regexp_full_match(before[len(before)], '\\d+\\.\\d{1,2}') OR regexp_full_match(before[len(before)], '\\d{1,3}(,\\d{2,3})+\\.\\d{1,2}'))"
_REASON = f"CASE WHEN regexp_matches(line, '{bl.SUMMARY_WORDS}') AND {_KIND} IS NULL THEN 'SUMMARY_VOCABULARY' WHEN len(s) = 0 AND NOT ({_RATE}) AND NOT regexp_matches(line, '{bl.LINE_DATE}') THEN 'NO_MONEY_NO_DATE' END"


def _filled(lines: DataFrame) -> DataFrame:
    """The lines with anything but spaces, those of Unicode too, as trim() of the SQL takes them off."""
    return lines.where(F.col("line").rlike(r"[^\p{Zs}]"))


@query(f"WITH {_B}, {_MONEY} SELECT doc_id, line_no, {_REASON} IS NULL AS item, {_REASON} AS reason FROM q WHERE trim(line) <> ''")
def ing04_line_verdicts(spark, sf):
    """Whether a line is a charge, and if not, why."""
    b = _filled(_bill_lines(spark, sf)).select("doc_id", "line_no", bl.bill_line(F.col("line")).alias("x"))
    return b.select("doc_id", "line_no", "x.item", "x.reason")


@query(f"WITH {_B}, {_MONEY}, v AS (SELECT doc_id, {_REASON} AS reason, {_KIND} AS kind FROM q WHERE trim(line) <> '') SELECT doc_id, count(*) FILTER (reason IS NULL AND kind IS NULL) AS charges, count(*) FILTER (kind IS NOT NULL) AS summaries, count(*) FILTER (reason = 'SUMMARY_VOCABULARY') AS vocabulary, count(*) FILTER (reason = 'NO_MONEY_NO_DATE') AS without_money FROM v GROUP BY 1")
def agg13_bill_stats(spark, sf):
    b = _filled(_bill_lines(spark, sf)).select("doc_id", bl.bill_line(F.col("line")).alias("x"))
    n = lambda c: F.count_if(c)
    r, k = F.col("x.reason"), F.col("x.kind")
    return b.groupBy("doc_id").agg(n(r.isNull() & k.isNull()).alias("charges"), n(k.isNotNull()).alias("summaries"), n(r == "SUMMARY_VOCABULARY").alias("vocabulary"), n(r == "NO_MONEY_NO_DATE").alias("without_money"))


@query(f"WITH {_B}, {_MONEY} SELECT doc_id, line_no, 'BL-' || upper(substr(sha256(doc_id || '|' || line_no || '|' || line), 1, 16)) AS line_id, CASE WHEN len(s) > 0 AND (NOT contains(split_part(s[len(s)], '.', 1), ',') OR regexp_full_match(split_part(s[len(s)], '.', 1), '\\d{{1,3}}(,\\d{{2,3}})+')) THEN cast(replace(replace(s[len(s)], ',', ''), '.', '') AS BIGINT) END AS strict_paise, {_KIND} IS NOT NULL AS summary FROM q WHERE trim(line) <> '' AND {_REASON} IS NULL")
def ing02_bill_lines(spark, sf):
    """The lines taken for charges or sums, with their ids and the amount of the strict rule."""
    b = _filled(_bill_lines(spark, sf)).select("doc_id", "line_no", "line", bl.bill_line(F.col("line")).alias("x")).where("x.item")
    return b.select("doc_id", "line_no", F.concat(F.lit("BL-"), F.upper(F.substring(F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("line_no").cast("string"), "line"), 256), 1, 16))).alias("line_id"), "x.strict_paise", F.col("x.kind").isNotNull().alias("summary"))


@query(f"WITH {_B}, {_MONEY}, v AS (SELECT doc_id, line_no, {_KIND} AS kind, s FROM q WHERE len(s) > 0) SELECT doc_id, line_no, kind, cast(replace(replace(s[len(s)], ',', ''), '.', '') AS BIGINT) AS paise FROM v WHERE kind IN ('subtotal', 'grand_total', 'net_payable') AND regexp_matches(s[len(s)], '^(\\d{{1,3}}(,\\d{{2,3}})*|\\d+)\\.\\d\\d$')")
def ing07_total_rows(spark, sf):
    b = _bill_lines(spark, sf).select("doc_id", "line_no", bl.bill_line(F.col("line")).alias("x"))
    return b.select("doc_id", "line_no", "x.kind", F.col("x.strict_paise").alias("paise")).where("kind in ('subtotal', 'grand_total', 'net_payable') and paise is not null").where("paise is not null")


_PRINTED_LABELS = ["Room rent", "Sub total", "Grand Total", "Net amount payable", "Service amount", "ADVANCE RECEIVED", "999311", "Department 999316", "Pharmacy MED12AB paracetamol tab", "OT charges", "Apr 2024 consultation visit", "Surgeon fee", "After discount", "CBC test", "ambulance", "Total of ward charges", ""]


@query("SELECT x.i AS line_no, x.label AS label, x.d AS date, x.code AS code FROM (SELECT unnest([" + ", ".join(f"{{'i': {i}::BIGINT, 'label': '{v}', 'd': {d}, 'code': {c}}}" for i, (v, d, c) in enumerate(zip(_PRINTED_LABELS, ["'12/04/2024'"] + ["NULL"] * 16, ["NULL"] * 8 + ["'MED12AB'"] + ["NULL"] * 8), 1)) + "]) AS x)")
def ing03_labels(spark, sf):
    """The printed bill's lines taken apart into label, date and code."""
    rows = spark.createDataFrame(list(enumerate(_PRINTED, 1)), "line_no bigint, line string")
    return rows.select("line_no", bl.label_parts(F.col("line")).alias("x")).select("line_no", "x.label", "x.date", "x.code")


def _sql_words(table, text: str) -> str:
    return " ".join(f"WHEN {' OR '.join(f'contains({text}, {chr(39)}{w}{chr(39)})' for w in ws)} THEN '{k}'" for k, ws in table)


@query(f"WITH x AS (SELECT DISTINCT line, lower(line) AS low FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)), c AS (SELECT line, low, CASE {_sql_words(bl.BILL_CATEGORIES, 'low')} ELSE 'miscellaneous' END AS c FROM x) SELECT line, CASE WHEN c = 'surgery' THEN CASE WHEN contains(low, 'surgeon') THEN 'surgeon' ELSE 'ot_charges' END ELSE c END AS category, CASE {_sql_words(bl.DEDUCTION_HEADS, 'low')} ELSE line END AS head FROM c")
def ing14_categories(spark, sf):
    """The bill category and the deduction head of every different line."""
    x = table(spark, sf, "documents").where("text is not null").select(F.explode(F.split("text", "\n")).alias("line")).distinct()
    return x.select("line", bl.bill_category(F.col("line")).alias("category"), bl.deduction_head(F.col("line")).alias("head"))


@query("SELECT doc_id, s.state AS state, s.reason AS reason FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 THEN {'state': 'VERIFIED', 'reason': NULL} WHEN doc_id % 5 = 0 THEN {'state': 'CONFLICTING', 'reason': 'DUAL_READER_DISAGREEMENT'} WHEN doc_id % 7 = 0 THEN CASE WHEN doc_id % 4 = 1 THEN {'state': 'UNREADABLE', 'reason': 'NO_UNAMBIGUOUS_AMOUNT_READING'} ELSE {'state': 'MISSING', 'reason': 'AMOUNT_NOT_STATED_OR_NOT_PARSED'} END WHEN doc_id % 3 = 0 THEN {'state': 'QUARANTINED', 'reason': 'SINGLE_READER_OR_AMBIGUOUS_READING'} WHEN doc_id % 4 = 1 THEN {'state': 'UNREADABLE', 'reason': 'AMOUNT_NOT_VERIFIED'} ELSE {'state': 'MISSING', 'reason': 'AMOUNT_NOT_STATED_OR_NOT_PARSED'} END AS s FROM documents)")
def ing16_amount_states(spark, sf):
    """States of amounts whose readings are in fixed classes of documents."""
    k = F.col("doc_id")
    s = bl.amount_state((k % 2 == 0) & (k % 3 == 0), k % 5 == 0, k % 7 == 0, F.lit(False), k % 3 == 0, k % 4 == 1)
    return table(spark, sf, "documents").select("doc_id", s.alias("s")).select("doc_id", "s.state", "s.reason")


@query(f"WITH {_PAGE}, s AS (SELECT DISTINCT corpus_document_id AS document_id, anchor FROM clause_spec WHERE anchor <> ''), f AS (SELECT s.document_id, s.anchor, page_number, page_read_id, instr(t, anchor) - 1 AS place FROM s JOIN p ON s.document_id = p.document_id WHERE t IS NOT NULL AND (length(t) - length(replace(t, anchor, ''))) // length(anchor) = 1) SELECT document_id, anchor, min_by(page_read_id, (page_number, page_read_id)) AS page_read_id, min_by(place, (page_number, page_read_id))::BIGINT AS char_start FROM f GROUP BY 1, 2")
def ing19_unique_sources(spark, sf):
    """The first page of a document on which a string stands exactly once, and where. Documents with very many pages are salted."""
    s = table(spark, sf, "clause_spec").where("anchor <> ''").select(F.col("corpus_document_id").alias("document_id"), "anchor").distinct()
    p = _pages(spark, sf).where("t is not null and document_id is not null").select("document_id", "page_number", "page_read_id", "t")
    f = salted_join(p, s.where("document_id is not null"), "document_id").where(tx.occurrences(F.col("t"), F.col("anchor")) == 1)
    return f.groupBy("document_id", "anchor").agg(F.min(F.struct("page_number", "page_read_id", (F.instr("t", F.col("anchor")) - 1).alias("at"))).alias("x")).select("document_id", "anchor", "x.page_read_id", F.col("x.at").cast("bigint").alias("char_start"))


# ---------------------------------------------------------------- quotes

_Q = r"q AS (SELECT DISTINCT citation_id, lower(trim(ref_id)) AS k, quote FROM citation WHERE ref_type = 'policy_clause' AND quote <> ''), c AS (SELECT lower(trim(clause_id)) AS k, max(original_text) AS t, max(char_start) AS base FROM policy_clause WHERE original_text IS NOT NULL GROUP BY 1), j AS (SELECT citation_id, quote, t, base FROM q JOIN c USING (k))"


def _quoted(spark, sf) -> DataFrame:
    key = lambda c: F.lower(F.trim(c))
    q = table(spark, sf, "citation").where("ref_type = 'policy_clause' and quote <> ''").select("citation_id", key("ref_id").alias("k"), "quote").distinct()
    c = table(spark, sf, "policy_clause").where("original_text is not null").groupBy(key("clause_id").alias("k")).agg(F.max("original_text").alias("t"), F.max("char_start").alias("base"))
    return salted_join(q, c, "k")


@query(f"WITH {_Q} SELECT citation_id, instr(t, quote) - 1 AS char_start, instr(t, quote) - 1 + length(quote) AS char_end, base + instr(t, quote) - 1 AS artifact_start FROM j WHERE (length(t) - length(replace(t, quote, ''))) // length(quote) = 1")
def txt26_exact_spans(spark, sf):
    """Where a quote that stands once in its clause stands, in the clause and in the document."""
    j = _quoted(spark, sf).where(tx.occurrences(F.col("t"), F.col("quote")) == 1)
    at = F.instr("t", F.col("quote")) - 1
    return j.select("citation_id", at.cast("bigint").alias("char_start"), (at + F.length("quote")).cast("bigint").alias("char_end"), (F.col("base") + at).cast("bigint").alias("artifact_start"))


@query(rf"WITH {_Q}, w AS (SELECT citation_id, quote, t FROM j UNION ALL VALUES (-1, 'shall do not follow', 'the insurer shalldo not  follow the list'), (-2, 'a b', 'ab and a  b')), e AS (SELECT citation_id, quote, t, regexp_replace(quote, '\s', '', 'g') AS eq, regexp_replace(t, '\s', '', 'g') AS et FROM w) SELECT citation_id, instr(et, eq) - 1 AS elided_start FROM e WHERE eq <> '' AND NOT contains(t, quote) AND (length(et) - length(replace(et, eq, ''))) // length(eq) = 1")
def txt27_elided(spark, sf):
    """Quotes that differ from their clause in white space only, and stand there once; two are planted."""
    planted = spark.createDataFrame([(-1, "shall do not follow", "the insurer shalldo not  follow the list"), (-2, "a b", "ab and a  b")], "citation_id bigint, quote string, t string")
    bare = lambda c: F.regexp_replace(c, r"\s", "")
    e = _quoted(spark, sf).select("citation_id", "quote", "t").unionByName(planted).where(~F.col("t").contains(F.col("quote"))).select("citation_id", bare("quote").alias("eq"), bare("t").alias("et")).where("eq <> ''")
    return e.where(tx.occurrences(F.col("et"), F.col("eq")) == 1).select("citation_id", (F.instr("et", F.col("eq")) - 1).cast("bigint").alias("elided_start"))


@query(f"WITH {_PAGE}, q AS (SELECT DISTINCT citation_id, document_id, quote FROM citation WHERE length(quote) >= 12 AND document_id IS NOT NULL) SELECT citation_id, page_read_id, instr(t, quote) - 1 AS char_start FROM q JOIN p ON q.document_id = p.document_id WHERE t IS NOT NULL AND (length(t) - length(replace(t, quote, ''))) // length(quote) = 1")
def txt09_all_occurrences(spark, sf):
    """Every page of its document on which a quote stands once."""
    q = table(spark, sf, "citation").where("length(quote) >= 12 and document_id is not null").select("citation_id", "document_id", "quote").distinct()
    p = _pages(spark, sf).where("t is not null and document_id is not null").select("document_id", "page_read_id", "t")
    j = salted_join(q, p, "document_id").where(F.col("t").contains(F.col("quote"))).where(tx.occurrences(F.col("t"), F.col("quote")) == 1)
    return j.select("citation_id", "page_read_id", (F.instr("t", F.col("quote")) - 1).cast("bigint").alias("char_start"))


@query()
def txt25_checked_quotes(spark, sf):
    """All tiers with scores, offsets in the clause, differences and the note on artefacts of spacing."""
    from ledgerloom.operators.evidence import check_quotes

    j = _quoted(spark, sf)
    return check_quotes(j.select("citation_id", "quote", F.col("t").alias("text")))


# ---------------------------------------------------------------- personal data


@query(f"WITH {_DOCS}, v AS (SELECT doc_id, text AS v FROM docs WHERE text IS NOT NULL) SELECT doc_id, concat_ws(' ', CASE WHEN " + " OR ".join(f"regexp_matches(v, '{p}')" for p in tx.IDENTIFIERS.values()) + " THEN 'IDENTIFIER' END, CASE WHEN length(v) > 400 THEN 'LONG_TEXT' END, CASE WHEN regexp_matches(v, '\\S{65,}') THEN 'LONG_TOKEN' END) AS leaks FROM v")
def txt18_leaks(spark, sf):
    return with_planted(spark, sf).where("text is not null").select("doc_id", F.array_join(tx.leaks(F.col("text")), " ").alias("leaks"))


@query()
def txt16_masked(spark, sf):
    """Texts masked to their shape: identifiers and field names by kind, words to their first letters, the first six words only."""
    return with_planted(spark, sf).where("text is not null").select("doc_id", tx.masked(F.col("text")).alias("masked"))
