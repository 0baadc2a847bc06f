"""Text columns: signatures, markers, identifiers, fingerprints. All of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that change what a sentence does.
NEGATIONS = "not no never none neither nor cannot without unless except excluding exclude excluded prohibit prohibited".split()
MODALS = "shall must may should will would ought required permitted".split()
# Instruction-like content, by name.
INJECTIONS = {
    "ignore-instructions": r"(?is)ignore (all )?(previous|prior|above) (instructions|prompts|rules)",
    "disregard": r"(?is)disregard (the )?(above|previous|prior)",
    "role-override": r"(?is)you (are|must|should) (now )?(act as|behave as|respond as)",
    "system-tag": r"(?is)\bsystem\s*:",
    "assistant-tag": r"(?is)\bassistant\s*:",
    "outcome-instruction": r"(?is)mark (this|the) (claim|bill|deduction) (as )?(approved|payable|unlawful)",
    "suppression-instruction": r"(?is)do not (report|flag|deduct)",
    "meta": r"(?is)\bprompt\s*injection\b",
    "encoded-payload": r"(?is)base64\s*:",
    "special-token": r"(?is)<\|.*?\|>",
    "override": r"(?is)\boverride\b.*\b(verdict|rule|calculation)\b",
}
# Fixed value: characters without a width of their own, and marks of direction.
ZERO_WIDTH = r"[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{feff}]"


def let(value: Column, then) -> Column:
    """then(value), with value evaluated once however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _other_than(*words: str) -> str:
    """A pattern of capital letters, as many as each of the words has, that are none of them. Without lookahead, so every engine reads it."""
    if words == ("",):
        return "(?!)"
    heads = sorted({w[0] for w in words})
    rest = f"[{''.join(c for c in map(chr, range(65, 91)) if c not in heads)}][A-Z]{{{len(words[0]) - 1}}}"
    longer = [f"{h}{_other_than(*[w[1:] for w in words if w[0] == h])}" for h in heads if len(words[0]) > 1]
    return f"(?:{'|'.join([rest, *longer])})"


# Identifier shapes, by kind.
IDENTIFIERS = {
    "PAN": r"(?i)\b[A-Z]{5}\d{4}[A-Z]\b",
    "AADHAAR12": r"(?i)\b[2-9]\d{11}\b",
    "AADHAAR_SPACED": r"(?i)\b\d{4}\s?\d{4}\s?\d{4}\b",
    "MOBILE": r"(?i)\b[6-9]\d{9}\b",
    "PASSPORTISH": r"(?i)\b[A-Z]{3}\d{7}\b",
    "GSTIN": r"(?i)\b\d{2}[A-Z]{5}\d{4}[A-Z]\d[Z][A-Z0-9]\b",
    "EMAIL": r"(?i)[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "AADHAAR_ALT": r"(?i)\b9\d{9}\b",
    # letters and a number, but no currency before it
    "DOCUMENT_NUMBER": rf"(?i)\b(?:[A-Z]{{2,4}}\d{{6,12}}|{_other_than('RS')}[-/#:]\d{{6,12}}|(?:{_other_than('INR', 'USD', 'EUR', 'GBP', 'MRP')}|[A-Z]{{4}})[\s:/#-]\d{{6,12}})\b",
    "PATIENT_NUMBER": r"(?i)\b(?:UHID|MRN|MR\s?NO|IP\s?NO|REG(?:ISTRATION)?\s?NO)[\s:/#-]*[A-Z0-9]{4,14}\b",
}
# Identifiers that are a person's for certain, those made of digits only, field names that introduce a person, and those of them that are enough.
HARD = ("PAN", "AADHAAR12", "AADHAAR_SPACED", "GSTIN", "EMAIL", "MOBILE")
NUMERIC = ("AADHAAR12", "AADHAAR_SPACED", "AADHAAR_ALT", "MOBILE")
FIELD_HINTS = ("patient name", "name of patient", "insured name", "guardian", "father", "mother", "address", "uhid", "ip no", "mrn", "mobile", "phone", "aadhaar", "pan", "email")
PERSON_HINTS = FIELD_HINTS[:10]
# Lines that store a digest.
DIGEST_WORDS, DIGEST_LINE = r"(?i)(?:hash|sha256|sha16|digest)", r'^\s*"[0-9a-f]{8,}"\s*,?\s*$'
MOST_LOGGED, LONGEST_TEXT = 64, 400
# Content that is no identifier but isn't to be published either.
MARKERS = {"DATE_DMY": r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", "DATE_DMONY": r"\b\d{1,2}\s+[A-Z][a-z]{2}\s+\d{4}\b", "MONEY": r"(?:Rs\.?|\x{20b9})\s?\d[\d,]*\.?\d{0,2}"}
PERSON_FIELDS = r"(?i)\b(" + "|".join(PERSON_HINTS) + r")\b"
ANY_FIELD = r"(?i)\b(" + "|".join(FIELD_HINTS) + r")\b"


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def numeric_signature(text: Column) -> Column:
    """Every number of the text, without grouping and outer dots, sorted: two spans with one signature print the same numbers."""
    clean = F.transform(found(text, r"\d[\d,\. ]*\d|\d"), lambda x: F.regexp_replace(F.regexp_replace(x, r"[,\s]", ""), r"^\.+|\.+$", ""))
    return F.array_sort(F.filter(clean, lambda x: x != ""))


def bearing_signature(text: Column) -> Column:
    """Negation and modal words of the text, sorted."""
    return F.array_sort(F.filter(found(F.lower(text), "[a-z]+"), lambda w: w.isin(NEGATIONS + MODALS)))


def alnum(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^a-z0-9]", "")


def item_key(c: Column) -> Column:
    """Lower case, bracketed parts dropped, runs of anything but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"\([^)]*\)", " "), r"[^a-z0-9]+", " "))


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def occurrences(text: Column, quote: Column) -> Column:
    """How often quote stands in text, overlaps not counted; null for an empty quote."""
    return F.when(F.length(quote) > 0, ((F.length(text) - F.length(F.replace(text, quote, F.lit("")))) / F.length(quote)).cast("bigint"))


def redacted(text: Column) -> Column:
    """Identifiers as <KIND>, other digits as dots: shape stays, content doesn't."""
    for kind, pattern in IDENTIFIERS.items():
        text = F.regexp_replace(text, pattern, f"<{kind}>")
    return F.regexp_replace(text, r"\d", "•")


def masked(text: Column, keep: int = 3, words: int = 6) -> Column:
    """redacted(), field names as <NAME>, of each longer word its first `keep` letters and dots, of a shorter one its first, and of the whole the first
    `words` words."""
    for kind, pattern in IDENTIFIERS.items():
        text = F.regexp_replace(text, pattern, f"<{kind}>")
    for hint in FIELD_HINTS:
        text = F.regexp_replace(text, rf"(?i)\b{hint}\b", f"<{hint.upper()}>")
    dots = lambda n: F.repeat(F.lit("•"), n)
    word = lambda w: F.when(~w.rlike("^[A-Za-z]{2,}$"), F.regexp_replace(w, r"\d", "•")).when(F.length(w) <= keep + 1, F.concat(F.left(w, F.lit(1)), dots(F.length(w) - 1))).otherwise(F.concat(F.left(w, F.lit(keep)), dots(F.length(w) - keep)))
    whole = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z]{2,}|[^A-Za-z]+|[A-Za-z]"), F.lit(0)), word), "")
    short = lambda x: let(F.split(F.trim(F.regexp_replace(x, r"\s+", " ")), " "), lambda t: F.when(F.size(t) > words, F.concat(F.array_join(F.slice(t, 1, words), " "), F.lit("…"))).otherwise(x))
    return let(whole, short)


def leaks(value: Column) -> Column:
    """What keeps a published value from being safe: identifiers, a text that is too long, a single token that is too long."""
    hard = F.lit(False)
    for kind, pattern in IDENTIFIERS.items():
        hard = hard | value.rlike(pattern)
    return F.array_compact(F.array(F.when(hard, "IDENTIFIER"), F.when(F.length(value) > LONGEST_TEXT, "LONG_TEXT"), F.when(value.rlike(rf"\S{{{MOST_LOGGED + 1},}}"), "LONG_TOKEN")))


def canonical_json(fields: dict[str, Column]) -> Column:
    """The fields as compact JSON in order of name, nulls kept. Doubles and floats can't be hashed reproducibly: give strings or integers."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in sorted(fields.items())]), {"ignoreNullFields": "false"})


def uuid5_url(name: Column) -> Column:
    """The version 5 UUID of a name in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), name.cast("binary")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def safe_filename(c: Column) -> Column:
    """The last part of a path, without control characters, dots and spaces around it, at most 255 characters; upload.pdf where nothing is left."""
    last = F.regexp_replace(F.coalesce(c, F.lit("upload.pdf")), r"^.*[/\\]", "")
    safe = F.regexp_replace(F.regexp_replace(last, r"[\p{C}\p{Zl}\p{Zp}]", "_"), r"^[ .]+|[ .]+$", "")
    suffix = F.when(F.lower(safe).endswith(".pdf"), ".pdf").otherwise("")
    cut = F.concat(F.regexp_replace(F.left(safe, F.lit(255) - F.length(suffix)), r"[ .]+$", ""), suffix)
    return F.when(safe == "", "upload.pdf").when(F.length(safe) > 255, cut).otherwise(safe)


# Headings, in the order in which they are tried.
HEADINGS = (r"^[ \t]*(\d{1,2}(?:\.\d{1,2}){0,3})[.)]?[ \t]+([A-Z][^\n]{2,110})$", r"^[ \t]*(Section[ \t]+\d{1,2})[.:]?[ \t]+([^\n]{2,110})$", r"^[ \t]*([IVXLC]{1,5})[.)]?[ \t]+([A-Z][^\n]{2,110})$")


def heading(line: Column) -> Column:
    """struct<label, heading> of a line that is one, by the first pattern that fits; else null."""
    return F.coalesce(*[F.when(line.rlike(p), F.struct(F.trim(F.regexp_extract(line, p, 1)).alias("label"), F.trim(F.regexp_extract(line, p, 2)).alias("heading"))) for p in HEADINGS])


def iso_date(c: Column) -> Column:
    """`2019-01-18`, `16/09/2019`, `22 May 2018` and the like to a date; null where none fits."""
    s = F.trim(c)
    dmy = F.concat_ws("-", F.regexp_extract(s, r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})$", 3), F.lpad(F.regexp_extract(s, r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})$", 2), 2, "0"), F.lpad(F.regexp_extract(s, r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})$", 1), 2, "0"))
    months = F.array(*[F.lit(m) for m in ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")])
    named = r"^(\d{1,2}) ([A-Za-z]{3})[a-z]* (\d{4})$"
    month = F.array_position(months, F.lower(F.regexp_extract(s, named, 2)))
    dmony = F.concat_ws("-", F.regexp_extract(s, named, 3), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(s, named, 1), 2, "0"))
    text = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), s).when(s.rlike(r"^\d{1,2}[/.-]\d{1,2}[/.-]\d{4}$"), dmy).when(s.rlike(named), dmony)
    return text.try_cast("date")


# Names of document roles and what they stand for.
ROLE_ALIASES = {"policy": "policy_wording", "policy_wording": "policy_wording", "policy_schedule": "policy_schedule", "hospital_bill": "bill", "bill": "bill", "settlement_letter": "settlement", "settlement": "settlement"}


def document_role(c: Column) -> Column:
    """The role a name stands for, without case and outer spaces; null for any other."""
    name = F.lower(F.trim(c))
    return F.coalesce(*[F.when(name == k, v) for k, v in ROLE_ALIASES.items()])


def reason(kind: str, **detail: Column) -> Column:
    """`KIND(name=value, ...)` of details that are numbers, ids or hashes, never texts; a null detail is left out."""
    return F.concat(F.lit(f"{kind}("), F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), c.cast("string")) for k, c in detail.items()]), F.lit(")"))
