"""Lines of bills and settlement letters, fields of wordings and schedules: what a line is, and what stands in it. All of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.money import let, line_money

# Words of rows that sum up others, of rows of a bill's summary, and of letters.
SUMMARY_KINDS = {
    "grand_total": r"(?i)\bgrand\s+total\b",
    "net_payable": r"(?i)\bnet\s+amount\s+payable\b|\bnet\s+payable\b|\bnet\s+amount\b",
    "subtotal": r"(?i)\bsub\s*-?total\b|\btotal\s+of\b",
    "other_summary": r"(?i)\btotal\b|\bsub\s*-?total\b|\bgrand\s+total\b|\bnet\s+amount\b|\bamount\s+payable\b|\bamount\s+received\b|\bbalance\s+(?:due|payable)\b|\bto\s+be\s+refund\b|\brefund\b|\bcash\s+discount\b|\bround\s*-?\s*off\b|\badvance\s+(?:paid|received)\b|\bgross\s+amount\b|\bcompany\s+credit\s+limit\b|\bdeposit\b|\bbill\s+amount\b|\bnet\s+payable\b",
}
SUMMARY_WORDS = r"(?i)\b(?:service\s+amount|bill\s+amount|amount\s+(?:payable|paid|received|refund\w*)|paid\s+amount|net\s+(?:amount|payable|amt)|balance\s+(?:amt|amount|due|payable)|advance\s+(?:received|paid|payment)|after\s+discount|total\s+discount|grand\s+total|sub\s*[- ]?total|refund(?:ed)?\s+to\s+(?:the\s+)?patient)\b"
LETTER_WORDS = r"(?i)\b(?:settle(?:ment|d|d\s+amount)?|sanction(?:ed)?|approved|approval|reject(?:ed|ion)?|denied|disallow(?:ed|ance)?|deduct(?:ed|ion)?|non[- ]?payable|not payable|payable|reimburs(?:ed|ement)|paid|payment|excess|shortfall|co[- ]?pay|co[- ]?payment)\b"
LINE_DATE = r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b\d{1,2}\s+[A-Za-z]{3}\s+\d{2,4}\b"
CODE = r"\b([A-Z]{1,4}[0-9][A-Z0-9]{2,10})\b"
CLAIMED = r"(?i)(?:claim(?:ed)?\s+amount|total\s+bill\s+amount)[^\d]+([\d,]+(?:\.\d{1,2})?)"
PAYABLE = r"(?i)(?:final\s+)?payable\s+amount[^\d]+([\d,]+(?:\.\d{1,2})?)"
NET_PAYABLE = r"(?i)net\s+payable[^\d]+([\d,]+(?:\.\d{1,2})?)"
INSURED, ROOM_RENT, CO_PAY = r"(?i)sum insured[^\d]+([\d,]+)", r"(?i)room rent[^\d]+([\d,]+(?:\s*(?:%|percent))?)", r"(?i)co-pay(?:ment)?[^\d]+(\d+)\s*%"
UIN, UIN_LABELLED = r"\b([A-Z]{2,5}HL[A-Z]{2,5}\d{5}V\d{6})\b", r"(?i)\bUIN\s*[:\-]?\s*([A-Z0-9]{8,25})\b"
EFFECTIVE = r"(?i)\b(?:effective|w\.e\.f\.?|with effect from|valid from)\b[^\n\d]{0,24}(\d{1,2}[-/ ](?:[A-Za-z]{3,9}|\d{1,2})[-/ ]\d{2,4})"
PERIOD = r"(?i)\bpolicy period\b[^\n\d]{0,40}(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})[^\n\d]{0,20}(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})"
# Words of categories, in the order in which they are tried.
BILL_CATEGORIES = (
    ("room", ("room", "bed", "ward", "nursing", "accommodation")), ("icu", ("icu", "intensive care", "itu")), ("surgery", ("surgeon", "surgery", "operation", "ot charges")), ("anaesthesia", ("anaesthesia",)),
    ("pharmacy", ("pharmacy", "medicine", "injection", "tab", "iv fluid", "consumable", "drugs", "disposables")), ("diagnostics", ("investigation", "test", "cbc", "ultrasound", "scan", "x-ray", "pathology", "lab")),
    ("consultation", ("consultation", "doctor", "visit")), ("procedures", ("procedure", "procedures")), ("ambulance", ("ambulance",)),
)
DEDUCTION_HEADS = (
    ("registration", ("registration", "admission")), ("consumables", ("consumables", "toiletries", "tissue", "gloves", "diet", "food", "nutrition")), ("co-pay", ("copay", "co-pay", "co payment")),
    ("room rent proportionate deduction", ("room", "rent", "limit", "proportionate")), ("non-medical expenses", ("non-medical",)),
)
DOCUMENT_TYPES = (("policy_wording", "policy wording"), ("regulation", "master circular"), ("regulation", "regulations"), ("hospital_bill", "hospital bill"), ("hospital_bill", "bill of supply"), ("hospital_bill", "interim bill"), ("claim_form", "claim form"))
SCHEDULE_WORDS = ("policy number", "sum insured", "room rent", "icu", "co-pay", "policy schedule")
WORDING_WORDS = ("coverage", "exclusions", "claims procedure", "waiting period", "definitions", "conditions")
DECISION = r"(?i)\b(settlement|settled|sanctioned|disallowed|deducted|claim decision)\b"


def first_of(table, low: Column) -> Column:
    """The name of the first entry any of whose words the text contains; null for none."""
    any_of = lambda ws: F.exists(F.array(*map(F.lit, ws)), lambda w: low.contains(w))
    return F.coalesce(*[F.when(any_of(ws), name) for name, ws in table])


def summary_kind(line: Column) -> Column:
    """grand_total, net_payable, subtotal, other_summary, or null for a line that sums nothing up."""
    return F.coalesce(*[F.when(line.rlike(p), k) for k, p in SUMMARY_KINDS.items()])


def label_parts(line: Column) -> Column:
    """struct<label, date, code>: serial number and date taken off, and the text up to the first amount."""
    body = F.regexp_replace(F.trim(line), r"^\s*(?:\d{1,3}\s*[.,)]?\s+|[A-Za-z]{1,2}\s+(?=\d{1,2}/))", "")
    date = F.regexp_extract(body, f"({LINE_DATE})", 1)

    def cut(x: Column) -> Column:
        rest = F.when(x["date"] != "", F.replace(x["body"], x["date"], F.lit(" "))).otherwise(x["body"])
        label = F.regexp_extract(rest, r"^(.*?)(?:\d[\d,]*[.,]\d{2}|$)", 1)
        return F.struct(F.regexp_replace(F.regexp_replace(label, r"\s{2,}", " "), r"^[ |\-:_;,]+|[ |\-:_;,]+$", "").alias("label"), F.nullif(x["date"], F.lit("")).alias("date"), F.nullif(F.regexp_extract(rest, CODE, 1), F.lit("")).alias("code"))

    return let(F.struct(body.alias("body"), date.alias("date")), cut)


def bill_line(line: Column) -> Column:
    """struct<item, reason, kind, paise, strict_paise, rate_paise, quantity_milli, class>: whether a line is a charge, and why not: SUMMARY_VOCABULARY, NO_MONEY_NO_DATE or
    CODE_SHAPED_ONLY; what it sums up; and its amounts."""

    def judge(m: Column) -> Column:
        kind, dated = summary_kind(line), line.rlike(LINE_DATE)
        strict, structure = m["strict"].isNotNull(), m["rated"]
        reason = F.when(line.rlike(SUMMARY_WORDS) & kind.isNull(), "SUMMARY_VOCABULARY").when(~strict & ~structure & ~dated, "NO_MONEY_NO_DATE").when(~dated & ~structure & ~strict, "CODE_SHAPED_ONLY")
        return F.struct(reason.isNull().alias("item"), reason.alias("reason"), kind.alias("kind"), m["paise"].alias("paise"), m["strict_paise"].alias("strict_paise"), m["rate_paise"].alias("rate_paise"), m["quantity_milli"].alias("quantity_milli"), m["class"].alias("class"))

    return let(line_money(line), judge)


def bill_category(label: Column) -> Column:
    low = F.lower(label)
    got = first_of(BILL_CATEGORIES, low)
    return F.when(got == "surgery", F.when(low.contains("surgeon"), "surgeon").otherwise("ot_charges")).otherwise(F.coalesce(got, F.lit("miscellaneous")))


def deduction_head(description: Column) -> Column:
    """The head of a deduction, or its own words."""
    return F.coalesce(first_of(DEDUCTION_HEADS, F.lower(description)), description)


def document_type(text: Column) -> Column:
    low = F.lower(text)
    schedule = low.contains("uin") & low.contains("schedule")
    first = F.when(low.contains("policy wording") | schedule, "policy_wording")
    return F.coalesce(first, *[F.when(low.contains(w), t) for t, w in DOCUMENT_TYPES[1:]], F.lit("unknown"))


def role_proposal(text: Column) -> Column:
    """bill, policy_schedule, policy_wording, settlement, or null where the first words don't say."""
    low, kind = F.lower(text), document_type(text)
    score = lambda ws: sum((low.contains(w).cast("int") for w in ws), F.lit(0))
    schedule, wording = score(SCHEDULE_WORDS), score(WORDING_WORDS)
    return F.when(kind == "hospital_bill", "bill").when(kind == "policy_wording", F.when((schedule > wording) & (schedule > 0), "policy_schedule").otherwise("policy_wording")).when((kind == "unknown") & low.rlike(DECISION), "settlement")


def first_paise(text: Column, *patterns: str) -> Column:
    """Paise of the first amount behind one of the patterns, tried in order."""
    from ledgerloom.functions.money import decimal_paise

    got = F.coalesce(*[F.nullif(F.regexp_replace(F.regexp_extract(text, p, 1), r"^,+|,+$", ""), F.lit("")) for p in patterns])
    return F.when(got.rlike(r"^\d"), decimal_paise(got))


def amount_state(usable: Column, disagree: Column, unreadable: Column, gap: Column, quarantined: Column, candidate: Column) -> Column:
    """struct<state, reason> of an amount: VERIFIED, CONFLICTING, UNREADABLE, QUARANTINED or MISSING."""
    of = lambda s, r: F.struct(F.lit(s).alias("state"), F.lit(r).cast("string").alias("reason"))
    return (
        F.when(usable, of("VERIFIED", None))
        .when(disagree, of("CONFLICTING", "DUAL_READER_DISAGREEMENT"))
        .when(unreadable | gap, F.when(candidate, of("UNREADABLE", "NO_UNAMBIGUOUS_AMOUNT_READING")).otherwise(of("MISSING", "AMOUNT_NOT_STATED_OR_NOT_PARSED")))
        .when(quarantined, of("QUARANTINED", "SINGLE_READER_OR_AMBIGUOUS_READING"))
        .when(candidate, of("UNREADABLE", "AMOUNT_NOT_VERIFIED"))
        .otherwise(of("MISSING", "AMOUNT_NOT_STATED_OR_NOT_PARSED"))
    )


def page_flags(text: Column, method: Column, confidence: Column, least_chars: int = 12) -> Column:
    """What is doubtful about a page's reading."""
    body = F.coalesce(text, F.lit(""))
    return F.array_compact(
        F.array(
            F.when(F.length(body) < least_chars, "NO_TEXT_LAYER"),
            F.when(method == "ocr", "OCR_APPLIED"),
            F.when(F.trim(body) == "", "NO_TEXT"),
            F.when(confidence < 0.6, "LOW_OCR_CONFIDENCE"),
            F.when(body.rlike(r"\d,\d{2}(?!\d)"), "DECIMAL_COMMA_CANDIDATE"),
            F.when(body.rlike(r"\d{6,}"), "LONG_DIGIT_RUN"),
        )
    )
