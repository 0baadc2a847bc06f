"""Money and number columns: exact integers only, no double ever holds an amount."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import let

# Shapes of printed numbers.
TOKEN = r"\d[\d,]*(?:\.\d{1,2})?|\d[\d.]*,\d{1,2}"
STRICT_TOKEN = r"\d[\d,]*\.\d{2}"
PRICED = r"(?i)(?:rs\.?|inr|\x{20b9})\s*(\d[\d,]*(?:\.\d+)?)"
UNIT = r"(?i)(\d[\d,\s]*(?:\.\d+)?)\s*(crores?|crs?|lakhs?|lacs?|lak|thousands?|haza?r|k)\b"
# Shapes of groupings and of whole tokens; the classes of tokens that can be read.
EQUAL, INDIAN, WESTERN = r"^\d{1,3},\d{3}$", r"^\d{1,3}(,\d{2})+,\d{3}$", r"^\d{1,3}(,\d{3})+$"
READABLE = ("strict_decimal", "grouped_integer", "plain_integer")
# Groups of changing width are possessive: otherwise the JVM takes a stack frame for each, and a number of some 2,000 groups ends the executor.
DECIMAL, DECIMAL_COMMA, GROUPED, WHOLE = r"^\d[\d,]*\.\d{1,2}$", r"^\d{1,3}(?:,\d{2,3}(?=,))*+,\d{2}$", r"^\d{1,3}(?:,\d{2,3})++$", r"^\d+$"
# Characters a scan reads for digits, in the order of their digits.
OCR_FROM, OCR_TO = "OoDQlI|i!LSsBZzGbqgT?A", "0000111111558226699774"
# Currency signs and words, trailing qualifiers, unit words and suffixes, characters of a scanned number.
CURRENCY_SIGNS, CURRENCY_WORDS = "\u20b9\u20a8", r"(?i)\b(inr|rs|re|rupees?|rupaye|rupaiya)\b\.?"
TRAILING = r"(?i)(/\s*-|/\s*=|-\s*/|\bonly\b)\.?\s*$"
UNITS = {"crore": 10_000_000, "crores": 10_000_000, "cr": 10_000_000, "crs": 10_000_000, "lakh": 100_000, "lakhs": 100_000, "lac": 100_000, "lacs": 100_000, "lak": 100_000, "thousand": 1_000, "thousands": 1_000, "hazaar": 1_000, "hazar": 1_000, "k": 1_000}
UNIT_SUFFIX = r"(\d+(?:\.\d+)?)\s*([LlKk])\b"
SCANNED = r"[0-9OoIlSsBbZzGgDqQAT?!|,.\-]*[0-9OoIlSsBbZzGgDqQAT?!|][0-9OoIlSsBbZzGgDqQAT?!|,.\-]*"
QUANTITY = r"[xX\u00d7]\s*(\d+(?:\.\d+)?)"
# Number words.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "- - twenty thirty forty fifty sixty seventy eighty ninety".split()


def whole_paise(digits: Column) -> Column:
    """Digits with grouping commas to paise; null where there are none, and for more paise than a bigint holds."""
    return F.try_multiply(F.regexp_replace(digits, ",", "").try_cast("bigint"), F.lit(100).cast("bigint"))


def decimal_paise(amount: Column) -> Column:
    """`1,180.5` to 118050: the fraction is read by place, further places are rounded half up. Null for more paise than a bigint holds."""
    whole = F.regexp_extract(amount, r"^([\d,]+)", 1)
    fraction = F.rpad(F.regexp_extract(amount, r"\.(\d+)$", 1), 3, "0")
    return F.try_add(whole_paise(whole), F.substring(fraction, 1, 2).cast("bigint") + F.when(F.substring(fraction, 3, 1) >= "5", 1).otherwise(0))


def grouping_style(integer: Column) -> Column:
    """plain, indian, western, ambiguous_equal (both), or invalid."""
    return (
        F.when(~integer.contains(","), "plain")
        .when(integer.rlike(EQUAL), "ambiguous_equal")
        .when(integer.rlike(INDIAN), "indian")
        .when(integer.rlike(WESTERN), "western")
        .otherwise("invalid")
    )


def token_class(token: Column) -> Column:
    """What a money token can be read as; decimal commas are told apart and not read."""
    grouped = F.regexp_extract(token, r"^([^.]*)", 1)
    return (
        F.when(token.rlike(DECIMAL), F.when(grouped.contains(",") & ~grouped.rlike(GROUPED), "malformed").otherwise("strict_decimal"))
        .when(token.rlike(DECIMAL_COMMA), "decimal_comma")
        .when(token.rlike(GROUPED), "grouped_integer")
        .when(token.rlike(WHOLE), "plain_integer")
        .otherwise("malformed")
    )


def strict_tokens(line: Column) -> Column:
    """What STRICT_TOKEN finds, in one pass: searched for as it is, a run of digits without a fraction is read again from each of its digits."""
    return F.filter(F.regexp_extract_all(line, F.lit(r"\d[\d,]*+(?:\.\d{2})?"), F.lit(0)), lambda t: t.contains("."))


def token_paise(token: Column) -> Column:
    """Paise of a token, null where its class can't be read, and for more than a bigint holds."""
    kind = token_class(token)
    return F.when(kind == "strict_decimal", decimal_paise(token)).when(kind.isin("grouped_integer", "plain_integer"), whole_paise(token))


def repaired_digits(token: Column) -> Column:
    """The number a misread token stands for: only number-shaped results of at least two digits, and no more different substitutions than half its
    length (at least one); the token itself otherwise."""
    fixed = F.translate(token, OCR_FROM, OCR_TO)
    swapped = F.size(F.array_distinct(F.filter(F.split(F.regexp_replace(token, r"[0-9,.]", ""), ""), lambda x: x != "")))
    ok = token.rlike(r"^[0-9,.OoDQlI|i!LSsBZzGbqgT?A]+$") & fixed.rlike(r"^\d[\d,]*(\.\d+)?$") & (F.length(F.regexp_replace(fixed, r"\D", "")) >= 2) & (swapped <= F.greatest(F.lit(1), F.floor(F.length(token) / 2)))
    return F.when(ok, fixed).otherwise(token)


def half_up(amount: Column, num: Column, den: Column) -> Column:
    """amount * num / den rounded half up (away from zero for negatives), in exact integers."""
    a, n, d = (c.cast("decimal(38,0)") for c in (F.abs(amount), num, den))
    return (F.signum(amount).cast("bigint") * F.floor((2 * a * n + d).cast("decimal(38,0)") / (2 * d)).cast("bigint")).cast("bigint")


def format_inr(paise: Column) -> Column:
    """Indian grouping: 12345678 paise as 1,23,456.78."""
    rupees = F.floor(F.abs(paise) / 100).cast("bigint").cast("string")
    head = F.regexp_replace(F.left(rupees, F.length(rupees) - 3), r"(?<=\d)(?=(\d{2})+$)", ",")
    grouped = F.when(F.length(rupees) <= 3, rupees).otherwise(F.concat(head, F.lit(","), F.right(rupees, F.lit(3))))
    return F.concat(F.when(paise < 0, "-").otherwise(""), grouped, F.lit("."), F.lpad((F.abs(paise) % 100).cast("string"), 2, "0"))


def _below_hundred(n: Column) -> Column:
    ones, tens = F.array(*map(F.lit, ONES)), F.array(*map(F.lit, TENS))
    return F.when(n < 20, F.element_at(ones, (n + 1).cast("int"))).otherwise(F.concat(F.element_at(tens, (F.floor(n / 10) + 1).cast("int")), F.when(n % 10 > 0, F.concat(F.lit(" "), F.element_at(ones, (n % 10 + 1).cast("int")))).otherwise("")))


def in_words(n: Column) -> Column:
    """A whole number below a thousand crore in Indian words; null beyond, and for negatives."""
    part = lambda v, name: F.when(v > 0, F.concat(_below_hundred(v), F.lit(f" {name}")))
    crore, lakh, thousand, hundred, rest = F.floor(n / 10_000_000), F.floor(n / 100_000) % 100, F.floor(n / 1_000) % 100, F.floor(n / 100) % 10, n % 100
    high = F.when(crore >= 100, F.concat_ws(" ", F.concat(_below_hundred(F.floor(crore / 100)), F.lit(" hundred")), F.when(crore % 100 > 0, _below_hundred(crore % 100)), F.lit("crore"))).otherwise(part(crore, "crore"))
    words = F.concat_ws(" ", high, part(lakh, "lakh"), part(thousand, "thousand"), part(hundred, "hundred"), F.when(rest > 0, _below_hundred(rest)))
    return F.when(n == 0, "zero").when((n > 0) & (n < 10_000_000_000), words)


def from_words(text: Column) -> Column:
    """Number words, Indian scales included, to an integer; null where any word is no number word or none is."""
    small = {w: i for i, w in enumerate(ONES)} | {w: 10 * i for i, w in enumerate(TENS) if i > 1} | {"fourty": 40}
    scales = {"thousand": 1_000, "lakh": 100_000, "lakhs": 100_000, "lac": 100_000, "lacs": 100_000, "crore": 10_000_000, "crores": 10_000_000}
    pick = lambda w, table: F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), w)
    tokens = F.filter(F.split(F.lower(text), r"[^A-Za-z]+"), lambda w: ~w.isin("", "and", "rupees", "only", "paise"))
    start = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("now"), F.lit(True).alias("ok"))

    def step(acc: Column, w: Column) -> Column:
        n, scale = pick(w, small), pick(w, scales)
        one = F.when(acc["now"] == 0, 1).otherwise(acc["now"])
        return F.struct(
            F.when(scale.isNotNull(), acc["total"] + one * scale).otherwise(acc["total"]).cast("bigint").alias("total"),
            F.when(n.isNotNull(), acc["now"] + n).when(w == "hundred", one * 100).otherwise(0).cast("bigint").alias("now"),
            (acc["ok"] & (n.isNotNull() | scale.isNotNull() | (w == "hundred"))).alias("ok"),
        )

    end = F.aggregate(tokens, start, step)
    return F.when(end["ok"] & (F.size(tokens) > 0), end["total"] + end["now"])


def plain_text(c: Column) -> Column:
    """White space as single spaces, dashes and quotes as ASCII ones, full-width ASCII as ASCII, control characters dropped. All in the JVM; compatibility forms
    beyond these are left to normalised() of the evidence operators."""
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    same = "".join(chr(o - 0xFEE0) for o in range(0xFF01, 0xFF5F))
    s = F.translate(c, "\u2013\u2014\u2212\u2018\u2019\u201c\u201d" + wide, "---\'\'\"\"" + same)
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"[\p{Z}\s]+", " "), r"[\p{Cc}\p{Cf}]", ""), " +", " "))


AMOUNT = "struct<normalised:string,paise:bigint,format:string,multiplier:bigint,ocr_corrected:boolean,flags:array<string>,confidence:double,error:string>"


def read_amount(raw: Column) -> Column:
    """A printed amount as a struct AMOUNT: paise, how it was written, the unit's multiplier, flags for everything doubtful, and a confidence that falls with them. An
    unreadable amount has null paise and an error: EMPTY, WORDS_UNPARSED, NO_NUMERIC_TOKEN or INVALID_NUMERIC_TOKEN. Fractions of a paisa are rounded half up and
    flagged."""
    return let(_bare(raw), lambda x: let(_number(x["body"]), lambda y: _judged(x, y)))


def _bare(raw: Column) -> Column:
    """struct<empty, marked, body>: the text without currency marks and trailing qualifiers."""

    def strip(text: Column) -> Column:
        bare = F.translate(text, CURRENCY_SIGNS, "  ")
        body = F.regexp_replace(F.regexp_replace(bare, CURRENCY_WORDS, " "), TRAILING, "")
        return F.struct(
            (F.coalesce(text, F.lit("")) == "").alias("empty"),
            (text.rlike(f"[{CURRENCY_SIGNS}]") | bare.rlike(CURRENCY_WORDS)).alias("marked"),
            F.coalesce(F.regexp_replace(body, r"^[ .\-:]+|[ .\-:]+$", ""), F.lit("")).alias("body"),
        )

    return let(plain_text(raw), strip)


def _number(body: Column) -> Column:
    """struct<words, said, unit, factor, token, fixed>: the number words, or the unit and the numeric token, as printed and as repaired."""
    known = [*ONES, *(t for t in TENS if t != "-"), "fourty", "hundred", "thousand", "lakh", "lakhs", "lac", "lacs", "crore", "crores"]
    words = F.filter(F.regexp_extract_all(F.lower(body), F.lit("[a-z]+"), F.lit(0)), lambda w: w.isin(known))
    units = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])

    def token(u: Column) -> Column:
        has, suffixed = u["unit"] != "", (u["unit"] == "") & (u["suffix"] != "")
        factor = F.when(has, F.element_at(units, u["unit"])).when(suffixed, F.when(u["suffix"] == "k", 1_000).otherwise(100_000)).otherwise(1).cast("bigint")
        number = F.when(has, F.regexp_extract(body, UNIT, 1)).when(suffixed, F.regexp_extract(body, UNIT_SUFFIX, 1)).otherwise(body)
        printed = F.regexp_replace(F.regexp_extract(number, f"({SCANNED})", 1), r"^[.\-]+|[.\-]+$", "")
        return let(printed, lambda t: F.struct((has | suffixed).alias("unit"), (suffixed & (u["suffix"] == "l")).alias("litre"), factor.alias("factor"), t.alias("token"), F.when(t.rlike(_SHAPE), t).otherwise(repaired_digits(t)).alias("fixed")))

    spoken = let(words, lambda w: F.when((F.size(w) > 0) & ~body.rlike(r"\d"), F.struct(from_words(F.array_join(w, " ")).alias("value"))))
    return F.struct(spoken.alias("spoken"), let(F.struct(F.lower(F.regexp_extract(body, UNIT, 2)).alias("unit"), F.lower(F.regexp_extract(body, UNIT_SUFFIX, 2)).alias("suffix")), token).alias("t"))


_SHAPE = r"^\d[\d,]*(\.\d+)?$"
_DOUBTS = {"SUSPICIOUS_GROUPING": 0.30, "SUSPICIOUS_DECIMALS": 0.10, "UNIT_AMBIGUOUS_L": 0.05, "OCR_CORRECTED": 0.15, "ROUNDED_TO_PAISE": 0.0}


def _judged(x: Column, y: Column) -> Column:
    t = y["t"]

    def value(f: Column) -> Column:
        fraction = F.regexp_extract(f, r"\.(\d+)$", 1)
        places = F.least(F.length(fraction), F.lit(10))
        digits = F.concat(F.regexp_replace(F.regexp_extract(f, r"^([\d,]+)", 1), ",", ""), F.left(fraction, places))
        return F.struct((digits.try_cast("decimal(38,0)") * t["factor"] * 100).cast("decimal(38,0)").alias("num"), F.pow(F.lit(10), places).cast("decimal(38,0)").alias("den"), F.length(fraction).alias("places"), grouping_style(F.regexp_extract(f, r"^([\d,]+)", 1)).alias("style"))

    def done(v: Column) -> Column:
        good, spoken = v["num"].isNotNull() & t["fixed"].rlike(_SHAPE), y["spoken"].isNotNull()
        hits = (v["style"] == "invalid", v["places"] > 2, t["litre"], ~t["token"].rlike(_SHAPE), (v["num"] % v["den"]) != 0)
        sure = F.lit(1.0)
        for (_, w), c in zip(_DOUBTS.items(), hits):
            sure = sure - F.when(c, w + 0.02).otherwise(0.0)
        flags = F.array_sort(F.array_compact(F.array(F.when(x["marked"], "CURRENCY_MARKER"), F.when(t["unit"], "UNIT_WORD"), *[F.when(c, n) for n, c in zip(_DOUBTS, hits)])))
        said = F.array_sort(F.array_compact(F.array(F.when(x["marked"], "CURRENCY_MARKER"), F.lit("PARsed_FROM_WORDS"))))
        error = F.when(x["empty"], "EMPTY").when(spoken, F.when(y["spoken"]["value"].isNull(), "WORDS_UNPARSED")).when(t["token"] == "", "NO_NUMERIC_TOKEN").when(~F.coalesce(good, F.lit(False)), "INVALID_NUMERIC_TOKEN")
        paise = F.floor((2 * v["num"] + v["den"]).cast("decimal(38,0)") / (2 * v["den"])).cast("bigint")
        ok = error.isNull()
        return F.struct(
            F.when(x["empty"], "").otherwise(x["body"]).alias("normalised"),
            F.when(ok, F.when(spoken, y["spoken"]["value"] * 100).otherwise(paise)).cast("bigint").alias("paise"),
            F.when(~ok, "plain").when(spoken, "words").when(t["unit"], "unit_word").otherwise(v["style"]).alias("format"),
            F.when(ok & ~spoken, t["factor"]).otherwise(1).cast("bigint").alias("multiplier"),
            F.coalesce(ok & ~spoken & hits[3], F.lit(False)).alias("ocr_corrected"),
            F.when(~ok, F.array().cast("array<string>")).when(spoken, said).otherwise(flags).alias("flags"),
            F.when(~ok, 0.0).when(spoken, 0.7).otherwise(F.round(F.greatest(F.lit(0.0), sure), 3)).alias("confidence"),
            error.alias("error"),
        )

    return let(F.when(t["fixed"].rlike(_SHAPE), value(t["fixed"])), done)


def paise_or_raise(raw: Column) -> Column:
    """The paise of a printed amount; a row that can't be read ends the query with an error."""
    failed = lambda got: F.raise_error(F.concat(F.lit("unreadable amount: "), F.coalesce(raw, F.lit("null")), F.lit(" "), got["error"])).cast("bigint")
    return let(read_amount(raw), lambda got: F.when(got["error"].isNull(), got["paise"]).otherwise(failed(got)))


def paise_in_words(paise: Column) -> Column:
    """`one lakh two rupees and five paise`, negatives with minus."""
    p = F.abs(paise) % 100
    tail = F.when(p > 0, F.concat(F.lit(" and "), _below_hundred(p), F.lit(" paise"))).otherwise("")
    return F.concat(F.when(paise < 0, "minus ").otherwise(""), in_words(F.floor(F.abs(paise) / 100)), F.lit(" rupees"), tail)


def ratio(num: Column, den: Column) -> Column:
    """struct<num, den>; null where den is 0."""
    return F.when(den != 0, F.struct(num.cast("bigint").alias("num"), den.cast("bigint").alias("den")))


def show_ratio(r: Column) -> Column:
    """At most four decimals, half to even, without trailing zeros."""
    shown = F.bround((r["num"] / r["den"]).cast("decimal(30,12)"), 4).cast("decimal(30,4)").cast("string")
    return F.when(r["num"] % r["den"] == 0, F.floor(r["num"] / r["den"]).cast("string")).otherwise(F.regexp_replace(F.regexp_replace(shown, "0+$", ""), r"\.$", ""))


def percent(raw: Column) -> Column:
    """The first number of a printed percentage as struct<num, den>, not divided by 100; null where there is none."""
    got = F.regexp_extract(raw, r"(\d+(?:\.\d+)?)", 1)
    frac = F.regexp_extract(got, r"\.(\d+)$", 1)
    return F.when(got != "", ratio(F.regexp_replace(got, r"\.", "").cast("bigint"), F.pow(F.lit(10), F.length(frac)).cast("bigint")))


def percent_as_fraction(p: Column) -> Column:
    return ratio(p["num"], p["den"] * 100)


def product_matches(quantity_milli: Column, rate: Column, amount: Column, tolerance: int = 100) -> Column:
    """Whether quantity x rate is the amount, to within `tolerance` paise."""
    return F.abs((quantity_milli.cast("decimal(38,0)") * rate - amount.cast("decimal(38,0)") * 1000).cast("decimal(38,0)")) <= tolerance * 1000


def amount_problems(paise: Column, raw: Column, words: Column, insured: Column, aggregate: Column, tolerance: int = 100) -> Column:
    """Codes of what speaks against an amount, in order; null cross-checks are left out."""
    spoken = from_words(words)
    return F.array_compact(
        F.array(
            F.when(paise < 0, "NEGATIVE_AMOUNT"),
            F.when((paise == 0) & raw.rlike(r"\d"), "ZERO_FROM_NONZERO_TEXT"),
            F.when(F.abs(spoken * 100 - paise) > tolerance, "WORDS_DIGITS_DISAGREE"),
            F.when(paise > 5 * insured, "IMPLAUSIBLE_VS_SI"),
            F.when(F.abs(paise - aggregate) > tolerance, "ARITHMETIC_MISMATCH"),
        )
    )


def scan_suspicion(token: Column) -> Column:
    """0 to 1: letters between digits, a group of one digit, more than two decimals."""
    parts = ((r"(?<=[1-9])[OoIlSsBbZzGgDTQq](?=\d)", 0.4), (r"\d,\d(?!\d)", 0.2), (r"\.\d{3,}", 0.3))
    return F.round(F.least(F.lit(1.0), sum((F.when(token.rlike(p), w).otherwise(0.0) for p, w in parts), F.lit(0.0))), 3)


def line_money(line: Column) -> Column:
    """struct<tokens, amount, class, paise, decimal_reading, strict, strict_paise, rated, rate_paise, quantity_milli, flags> of a bill line. The amount is the last money-shaped token; a
    decimal comma is refused and its other reading reported; the rate is the token before `x quantity`, and rated whether there is one and it isn't malformed: a decimal comma
    is a rate, of null paise. What a token is read as, and so rated and the flags, goes by its class: a readable number of more paise than a bigint holds has null paise only."""
    before = F.regexp_extract_all(F.regexp_extract(line, rf"^(.*?){QUANTITY}", 1), F.lit(TOKEN), F.lit(0))
    seen = F.struct(F.regexp_extract_all(line, F.lit(TOKEN), F.lit(0)).alias("a"), strict_tokens(line).alias("s"), F.try_element_at(before, F.lit(-1)).alias("rate"), F.regexp_extract(line, QUANTITY, 1).alias("quantity"))

    def read(x: Column) -> Column:
        last, strict = F.try_element_at(x["a"], F.lit(-1)), F.try_element_at(x["s"], F.lit(-1))
        return let(F.struct(last.alias("t"), strict.alias("s"), F.when(last.isNotNull(), token_class(last)).alias("kind"), token_paise(last).alias("paise")), lambda y: put(x, y))

    def put(x: Column, y: Column) -> Column:
        refused = y["t"].isNotNull() & ~y["kind"].isin(*READABLE)
        return F.struct(
            F.size(x["a"]).cast("bigint").alias("tokens"), y["t"].alias("amount"), y["kind"].alias("class"), y["paise"].alias("paise"),
            F.when(y["kind"] == "decimal_comma", F.regexp_replace(y["t"], ",", "").try_cast("bigint")).alias("decimal_reading"), y["s"].alias("strict"), token_paise(y["s"]).alias("strict_paise"),
            F.coalesce((x["quantity"] != "") & token_class(x["rate"]).isin(*READABLE, "decimal_comma") & x["rate"].isNotNull(), F.lit(False)).alias("rated"), F.when(x["quantity"] != "", token_paise(x["rate"])).alias("rate_paise"),
            F.when((x["quantity"] != "") & x["rate"].isNotNull(), F.round(x["quantity"].try_cast("decimal(18,4)") * 1000).cast("bigint")).alias("quantity_milli"),
            F.array_compact(F.array(F.when(refused, "AMOUNT_NOT_READABLE"), F.when(refused & (F.size(x["a"]) > F.size(x["s"])), "TOKEN_MISSED_BY_STRICT_RULE"), F.when(~refused & y["s"].isNotNull() & (y["s"] != y["t"]), "TAIL_RULE_AMBIGUOUS"))).alias("flags"),
        )

    return let(seen, read)


# ---------------------------------------------------------------- closed set of operations


def apply_operation(op: str, base: Column, **p: Column) -> Column:
    """One of the closed set: identity, subtract(amount), cap(limit), floor(limit), ceiling(limit), multiply_ratio(num, den), percentage(num, den), threshold(limit). Any other raises
    ValueError here. A ratio outside 0 to 1 and a percentage outside 0 to 100 give null."""
    if op == "identity":
        return base
    if op == "subtract":
        return base - p["amount"]
    if op in ("cap", "ceiling"):
        return F.least(base, p["limit"])
    if op == "floor":
        return F.greatest(base, p["limit"])
    if op == "multiply_ratio":
        return F.when(p["den"].isNotNull() & (p["den"] > 0) & (p["num"] >= 0) & (p["num"] <= p["den"]), half_up(base, p["num"], p["den"]))
    if op == "percentage":
        return F.when((p["den"] > 0) & (p["num"] >= 0) & (p["num"] <= 100 * p["den"]), half_up(base, p["num"], p["den"] * 100))
    if op == "threshold":
        return F.greatest(base - p["limit"], F.lit(0).cast("bigint"))
    raise ValueError(f"no operation: {op!r}")
