"""Queries of the money functions. Printed amounts are made from the order totals in ten ways of writing, and read again; their SQL never parses, it computes what has to come out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import money
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


def _printed(spark: SparkSession, sf: str) -> DataFrame:
    """o_orderkey, p (paise), way (0 to 9), raw."""
    p = F.round(F.col("o_totalprice") * 100).cast("bigint")
    o = table(spark, sf, "orders").select("o_orderkey", p.alias("p")).distinct().withColumn("way", (F.col("o_orderkey") % 10).cast("int")).withColumn("d", F.floor(F.col("p") / 100).cast("string"))
    d, inr = F.col("d"), money.format_inr(F.col("p"))
    k = F.floor(F.col("p") / 100_000)
    western = F.regexp_replace(d, r"(?<=\d)(?=(\d{3})+$)", ",")
    ways = [
        F.concat(F.lit("Rs. "), inr),
        F.concat(F.lit("₹"), d, F.lit("/-")),
        F.concat(d, F.lit("."), F.lpad((F.col("p") % 100).cast("string"), 2, "0")),
        F.concat(F.lit("INR  "), western),
        F.concat(F.floor(k / 100).cast("string"), F.lit("."), F.lpad((k % 100).cast("string"), 2, "0"), F.lit(" lakh only")),
        F.concat(F.lit("Rs "), (F.floor(F.col("p") / 10_000_000) + 1).cast("string"), F.lit("L")),
        F.translate(d, "058", "OSB"),
        F.concat(F.left(d, F.length("d") - 2), F.lit(","), F.right(d, F.lit(2))),
        F.concat(d, F.lit(".125")),
        F.concat(F.lit("Rupees "), F.initcap(money.in_words(F.floor(F.col("p") / 100))), F.lit(" Only")),
    ]
    return o.withColumn("raw", F.element_at(F.array(*ways), F.col("way") + 1))


_O = """o AS (SELECT DISTINCT o_orderkey, cast(round(o_totalprice * 100) AS BIGINT) AS p, (o_orderkey % 10)::INT AS way FROM orders), b AS (SELECT *, p // 100 AS r, cast(p // 100 AS VARCHAR) AS d FROM o),
 w AS (SELECT *, len(list_distinct(list_filter(string_split(d, ''), lambda x: x IN ('0', '5', '8')))) AS swaps FROM b)"""
_GROUPS = "CASE WHEN length(d) <= 3 THEN 'plain' WHEN length(d) <= 6 AND way = 3 OR length(d) <= 5 THEN 'ambiguous_equal' WHEN way = 3 THEN 'western' ELSE 'indian' END"
_FIXED = "(way <> 6 OR swaps = 0 OR swaps <= greatest(1, length(d) // 2))"


@query(f"""WITH {_O} SELECT o_orderkey,
 CASE WHEN NOT {_FIXED} THEN NULL WHEN way IN (0, 2) THEN p WHEN way = 4 THEN (p // 100000) * 100000 WHEN way = 5 THEN (p // 10000000 + 1) * 10000000 WHEN way = 8 THEN r * 100 + 13 ELSE r * 100 END::BIGINT AS paise,
 CASE WHEN NOT {_FIXED} THEN 'plain' WHEN way IN (0, 3) THEN {_GROUPS} WHEN way IN (4, 5) THEN 'unit_word' WHEN way = 7 THEN 'invalid' WHEN way = 9 THEN 'words' ELSE 'plain' END AS format,
 CASE WHEN NOT {_FIXED} THEN '' ELSE CASE way WHEN 0 THEN 'CURRENCY_MARKER' WHEN 1 THEN 'CURRENCY_MARKER' WHEN 3 THEN 'CURRENCY_MARKER' WHEN 4 THEN 'UNIT_WORD' WHEN 5 THEN 'CURRENCY_MARKER UNIT_AMBIGUOUS_L UNIT_WORD'
   WHEN 6 THEN CASE WHEN swaps > 0 THEN 'OCR_CORRECTED' ELSE '' END WHEN 7 THEN 'SUSPICIOUS_GROUPING' WHEN 8 THEN 'ROUNDED_TO_PAISE SUSPICIOUS_DECIMALS' WHEN 9 THEN 'CURRENCY_MARKER PARsed_FROM_WORDS' ELSE '' END END AS flags,
 CASE WHEN NOT {_FIXED} THEN 0.0 ELSE CASE way WHEN 5 THEN 0.93 WHEN 6 THEN CASE WHEN swaps > 0 THEN 0.83 ELSE 1.0 END WHEN 7 THEN 0.68 WHEN 8 THEN 0.86 WHEN 9 THEN 0.7 ELSE 1.0 END END::DOUBLE AS confidence,
 CASE WHEN NOT {_FIXED} THEN 'INVALID_NUMERIC_TOKEN' END AS error FROM w""")
def fun01_read_amounts(spark, sf):
    """Every way of writing an amount, with what is doubtful about it."""
    a = _printed(spark, sf).select("o_orderkey", money.read_amount(F.col("raw")).alias("a"))
    return a.select("o_orderkey", "a.paise", "a.format", F.array_join("a.flags", " ").alias("flags"), "a.confidence", "a.error")


@query(f"WITH {_O} SELECT o_orderkey, p AS paise FROM w WHERE way = 0")
def fun02_paise_or_raise(spark, sf):
    return _printed(spark, sf).where("way = 0").select("o_orderkey", money.paise_or_raise(F.col("raw")).alias("paise"))


@query("SELECT DISTINCT citation_id, trim(regexp_replace(regexp_replace(translate(quote, '–—−‘’“”', '---''''\"\"'), '[\\p{Z}\\s]+', ' ', 'g'), '[\\p{Cc}\\p{Cf}]', '', 'g')) AS plain FROM citation WHERE quote IS NOT NULL AND NOT regexp_matches(quote, '[！-～]') AND NOT regexp_matches(quote, '[\\p{Cc}\\p{Cf}]')")
def fun03_plain_text(spark, sf):
    """Quotes without full-width and invisible characters, which the SQL can't fold."""
    c = table(spark, sf, "citation").where("quote is not null").where(~F.col("quote").rlike(r"[！-～]") & ~F.col("quote").rlike(r"[\p{Cc}\p{Cf}]"))
    return c.select("citation_id", money.plain_text(F.col("quote")).alias("plain")).distinct()


@query(f"WITH {_O} SELECT o_orderkey, CASE WHEN way = 4 THEN 'lakh' WHEN way = 5 THEN 'l' END AS unit, CASE WHEN way IN (4, 5) THEN 100000 ELSE 1 END::BIGINT AS multiplier FROM w WHERE {_FIXED}")
def fun07_units(spark, sf):
    a = _printed(spark, sf).select("o_orderkey", "raw", money.read_amount(F.col("raw")).alias("a")).where("a.error is null")
    unit = F.coalesce(F.nullif(F.lower(F.regexp_extract("raw", money.UNIT, 2)), F.lit("")), F.nullif(F.lower(F.regexp_extract("raw", money.UNIT_SUFFIX, 2)), F.lit("")))
    return a.select("o_orderkey", F.when(F.col("a.format") == "unit_word", unit).alias("unit"), F.col("a.multiplier").alias("multiplier"))


_WORD = "CASE WHEN {n} < 20 THEN ['zero','one','two','three','four','five','six','seven','eight','nine','ten','eleven','twelve','thirteen','fourteen','fifteen','sixteen','seventeen','eighteen','nineteen'][{n} + 1] ELSE ['','','twenty','thirty','forty','fifty','sixty','seventy','eighty','ninety'][{n} // 10 + 1] || CASE WHEN {n} % 10 > 0 THEN ' ' || ['one','two','three','four','five','six','seven','eight','nine'][{n} % 10] ELSE '' END END"
_SPOKEN = f"""concat_ws(' ', CASE WHEN r // 100000 > 0 THEN {_WORD.format(n='(r // 100000)')} || ' lakh' END, CASE WHEN r // 1000 % 100 > 0 THEN {_WORD.format(n='(r // 1000 % 100)')} || ' thousand' END,
 CASE WHEN r // 100 % 10 > 0 THEN {_WORD.format(n='(r // 100 % 10)')} || ' hundred' END, CASE WHEN r % 100 > 0 THEN {_WORD.format(n='(r % 100)')} END)"""


@query(f"WITH {_O} SELECT o_orderkey, {_SPOKEN} || ' rupees' || CASE WHEN p % 100 > 0 THEN ' and ' || {_WORD.format(n='(p % 100)')} || ' paise' ELSE '' END AS words, r AS back FROM w")
def fun09_amount_in_words(spark, sf):
    """Order totals in words, and the rupees read back from them."""
    p = _printed(spark, sf).select("o_orderkey", money.paise_in_words(F.col("p")).alias("words"))
    return p.select("o_orderkey", "words", money.from_words(F.regexp_replace("words", " rupees.*$", "")).alias("back"))


@query("SELECT l_orderkey, sum(n)::BIGINT AS num, sum(d)::BIGINT AS den, CASE WHEN sum(n) % sum(d) = 0 THEN cast(sum(n) // sum(d) AS VARCHAR) ELSE regexp_replace(regexp_replace(printf('%.4f', (sum(n) / sum(d))::DOUBLE), '0+$', ''), '\\.$', '') END AS shown FROM (SELECT l_orderkey, round(l_quantity)::BIGINT AS n, 7 AS d FROM lineitem) GROUP BY 1")
def fun11_ratios(spark, sf):
    r = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(F.round("l_quantity").cast("bigint")).alias("num"), (F.count(F.lit(1)) * 7).alias("den"))
    return r.select("l_orderkey", "num", "den", money.show_ratio(money.ratio(F.col("num"), F.col("den"))).alias("shown"))


@query(f"""WITH {_O}, a AS (SELECT *, CASE WHEN o_orderkey % 17 = 0 THEN -p WHEN o_orderkey % 19 = 0 THEN 0 ELSE p END AS amount, CASE WHEN o_orderkey % 5 = 0 THEN r + CASE WHEN o_orderkey % 3 = 0 THEN 5 ELSE 0 END END AS said, CASE WHEN o_orderkey % 7 = 0 THEN p // 6 END AS si, CASE WHEN o_orderkey % 11 = 0 THEN p + o_orderkey % 300 END AS total FROM w)
 SELECT o_orderkey, concat_ws(' ', CASE WHEN amount < 0 THEN 'NEGATIVE_AMOUNT' END, CASE WHEN amount = 0 THEN 'ZERO_FROM_NONZERO_TEXT' END, CASE WHEN abs(said * 100 - amount) > 100 THEN 'WORDS_DIGITS_DISAGREE' END, CASE WHEN amount > 5 * si THEN 'IMPLAUSIBLE_VS_SI' END, CASE WHEN abs(amount - total) > 100 THEN 'ARITHMETIC_MISMATCH' END) AS problems FROM a""")
def fun12_amount_problems(spark, sf):
    """Totals changed in fixed classes of orders, with words, a sum insured and an aggregate to check against in others."""
    k, p, r = F.col("o_orderkey"), F.col("p"), F.floor(F.col("p") / 100)
    a = _printed(spark, sf)
    amount = F.when(k % 17 == 0, -p).when(k % 19 == 0, 0).otherwise(p).cast("bigint")
    words = F.when(k % 5 == 0, money.in_words(r + F.when(k % 3 == 0, 5).otherwise(0)))
    problems = money.amount_problems(amount, p.cast("string"), words, F.when(k % 7 == 0, F.floor(p / 6)), F.when(k % 11 == 0, p + k % 300))
    return a.select("o_orderkey", F.array_join(problems, " ").alias("problems"))


@query("SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice, abs(round(l_quantity)::HUGEINT * 1000 * cast(round(l_extendedprice * 100 / l_quantity) AS HUGEINT) - cast(round(l_extendedprice * 100) AS HUGEINT) * 1000) <= 100000 AS matches FROM (SELECT DISTINCT l_orderkey, l_partkey, l_quantity, l_extendedprice FROM lineitem WHERE l_quantity > 0)")
def fun13_products(spark, sf):
    """Whether quantity times the rounded rate is the price, to within a rupee."""
    rows = table(spark, sf, "lineitem").where("l_quantity > 0").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice").distinct()
    price = F.col("l_extendedprice") * 100
    return rows.withColumn("matches", money.product_matches(F.round("l_quantity").cast("bigint") * 1000, F.round(price / F.col("l_quantity")).cast("bigint"), F.round(price).cast("bigint")))


@query(r"WITH c AS (SELECT DISTINCT ON (clause_id) clause_id, regexp_extract(original_text, '(\d+(?:\.\d+)?) ?(?:per cent|%)', 1) AS n FROM policy_clause WHERE original_text IS NOT NULL), s AS (SELECT *, length(regexp_extract(n, '\.(\d+)$', 1)) AS k FROM c WHERE n <> '') SELECT clause_id, cast(replace(n, '.', '') AS BIGINT) AS num, cast(pow(10, k) AS BIGINT) AS den, cast(pow(10, k) AS BIGINT) * 100 AS fraction_den FROM s")
def fun14_percentages(spark, sf):
    """The first percentage of a clause as an exact ratio, and as a fraction."""
    c = table(spark, sf, "policy_clause").dropDuplicates(["clause_id"]).where("original_text is not null").select("clause_id", F.regexp_extract("original_text", r"(\d+(?:\.\d+)?) ?(?:per cent|%)", 1).alias("n")).where("n <> ''")
    p = c.select("clause_id", money.percent(F.col("n")).alias("p"))
    return p.select("clause_id", "p.num", "p.den", money.percent_as_fraction(F.col("p"))["den"].alias("fraction_den"))


@query(f"WITH {_O} SELECT o_orderkey, round(CASE WHEN way = 6 AND regexp_matches(translate(d, '058', 'OSB'), '[1-9][OoIlSsBbZzGgDTQq]\\d') THEN 0.4 ELSE 0 END + CASE WHEN way = 8 THEN 0.3 ELSE 0 END, 3)::DOUBLE AS suspicion FROM w WHERE way IN (1, 2, 6, 7, 8)")
def fun17_suspicion(spark, sf):
    return _printed(spark, sf).where("way in (1, 2, 6, 7, 8)").select("o_orderkey", money.scan_suspicion(F.col("raw")).alias("suspicion"))


_LINES = r"l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL), t AS (SELECT *, regexp_extract_all(line, '\d[\d,]*(?:\.\d{1,2})?|\d[\d.]*,\d{1,2}') AS a, regexp_extract_all(line, '\d[\d,]*\.\d{2}') AS s FROM l)"


def _lines(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", (F.col("pos") + 1).cast("bigint").alias("line_no"), "line")


@query(f"WITH {_LINES} SELECT doc_id, line_no, len(a) AS permissive, len(s) AS strict, array_to_string(list_filter(a, lambda x: NOT list_contains(s, x)), ' ') AS missed FROM t WHERE len(a) > 0")
def fun19_tokens(spark, sf):
    """Money-shaped tokens by the permissive and the strict rule, and those only the permissive one sees."""
    a, s = (F.regexp_extract_all("line", F.lit(p), F.lit(0)) for p in (money.TOKEN, money.STRICT_TOKEN))
    t = _lines(spark, sf).withColumn("a", a).withColumn("s", s).where("size(a) > 0")
    return t.select("doc_id", "line_no", F.size("a").cast("bigint").alias("permissive"), F.size("s").cast("bigint").alias("strict"), F.array_join(F.filter("a", lambda x: ~F.array_contains("s", x)), " ").alias("missed"))


@query(rf"""WITH {_LINES}, m AS (SELECT *, a[len(a)] AS x, s[len(s)] AS y FROM t WHERE len(a) > 0), c AS (SELECT *, CASE WHEN regexp_full_match(x, '\d[\d,]*\.\d{{1,2}}') THEN CASE WHEN contains(x, ',') AND NOT regexp_full_match(string_split(x, '.')[1], '\d{{1,3}}(,\d{{2,3}})+') THEN 'malformed' ELSE 'strict_decimal' END
   WHEN regexp_full_match(x, '\d{{1,3}}(,\d{{2,3}})*,\d{{2}}') THEN 'decimal_comma' WHEN regexp_full_match(x, '\d{{1,3}}(,\d{{2,3}})+') THEN 'grouped_integer' WHEN regexp_full_match(x, '\d+') THEN 'plain_integer' ELSE 'malformed' END AS class FROM m)
 SELECT doc_id, line_no, x AS amount, class, CASE WHEN class IN ('decimal_comma', 'malformed') THEN concat_ws(' ', 'AMOUNT_NOT_READABLE', CASE WHEN len(a) > len(s) THEN 'TOKEN_MISSED_BY_STRICT_RULE' END) WHEN y IS NOT NULL AND y <> x THEN 'TAIL_RULE_AMBIGUOUS' ELSE '' END AS flags FROM c""")
def fun22_line_readings(spark, sf):
    m = _lines(spark, sf).select("doc_id", "line_no", money.line_money(F.col("line")).alias("m")).where("m.tokens > 0")
    return m.select("doc_id", "line_no", "m.amount", "m.class", F.array_join("m.flags", " ").alias("flags"))


@query("SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice, cast(round(l_extendedprice * 100) AS BIGINT) AS rate_paise, cast(round(l_quantity * 1000) AS BIGINT) AS quantity_milli, (cast(round(l_extendedprice * 100) AS BIGINT) * l_quantity)::BIGINT AS paise FROM (SELECT DISTINCT l_orderkey, l_partkey, l_quantity, l_extendedprice FROM lineitem)")
def fun21_rate_and_quantity(spark, sf):
    """Bill lines printed as `label rate x quantity amount`, and read again."""
    r = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice").distinct()
    p = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    line = F.concat(F.lit("room rent "), money.format_inr(p), F.lit(" x "), F.col("l_quantity").cast("int").cast("string"), F.lit(" "), money.format_inr(p * F.col("l_quantity").cast("bigint")))
    m = r.withColumn("m", money.line_money(line))
    return m.select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "m.rate_paise", "m.quantity_milli", "m.paise")


@query(r"SELECT page_read_id, round(length(t) / (w * h), 8) AS text_density, len(regexp_extract_all(t, '\d[\d,]*(?:\.\d+)?')) AS numbers FROM (SELECT DISTINCT page_read_id, layout.text AS t, layout.width AS w, layout.height AS h FROM page_read) WHERE t IS NOT NULL AND w * h > 0")
def fun26_densities(spark, sf):
    p = table(spark, sf, "page_read").select("page_read_id", F.col("layout.text").alias("t"), F.col("layout.width").alias("w"), F.col("layout.height").alias("h")).distinct().where("t is not null and w * h > 0")
    return p.select("page_read_id", F.round(F.length("t") / (F.col("w") * F.col("h")), 8).alias("text_density"), F.regexp_count("t", F.lit(r"\d[\d,]*(?:\.\d+)?")).cast("bigint").alias("numbers"))


@query("SELECT page_read_id, CASE WHEN t IS NULL OR length(trim(t)) = 0 THEN 1.0 WHEN m = 'ocr' THEN 0.9 WHEN length(t) < 40 THEN 0.6 ELSE round(greatest(0, 0.3 - length(t) / 10000.0), 4) END::DOUBLE AS scan FROM (SELECT DISTINCT page_read_id, layout.text AS t, layout.method AS m FROM page_read)")
def fun27_scan_likelihood(spark, sf):
    """From no text, the reading's method and the length of the text."""
    p = table(spark, sf, "page_read").select("page_read_id", F.col("layout.text").alias("t"), F.col("layout.method").alias("m")).distinct()
    n = F.length("t")
    return p.select("page_read_id", F.when(F.col("t").isNull() | (F.length(F.trim("t")) == 0), 1.0).when(F.col("m") == "ocr", 0.9).when(n < 40, 0.6).otherwise(F.round(F.greatest(F.lit(0.0), 0.3 - n / 10000.0), 4)).alias("scan"))


@query(r"WITH l AS (SELECT page_read_id, unnest(string_split(t, chr(10))) AS line FROM (SELECT DISTINCT page_read_id, layout.text AS t FROM page_read WHERE layout.text IS NOT NULL)), f AS (SELECT page_read_id, count(*) AS n, count_if(len(regexp_extract_all(line, '\d[\d,]*(?:\.\d{1,2})?')) >= 2) AS k FROM l WHERE trim(line) <> '' GROUP BY 1) SELECT page_read_id, CASE WHEN n < 4 THEN 0.0 ELSE round(k / n, 4) END::DOUBLE AS table_likelihood FROM f")
def fun28_table_likelihood(spark, sf):
    """The share of lines with two amounts or more; pages of fewer than four lines are no tables."""
    p = table(spark, sf, "page_read").select("page_read_id", F.col("layout.text").alias("t")).distinct().where("t is not null").select("page_read_id", F.explode(F.split("t", "\n")).alias("line")).where("trim(line) <> ''")
    f = p.groupBy("page_read_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.regexp_count("line", F.lit(r"\d[\d,]*(?:\.\d{1,2})?")) >= 2).alias("k"))
    return f.select("page_read_id", F.when(F.col("n") < 4, 0.0).otherwise(F.round(F.col("k") / F.col("n"), 4)).alias("table_likelihood"))


# ---------------------------------------------------------------- exact operations

_BASES = "b AS (SELECT l_orderkey, sum(cast(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS base, (l_orderkey % 120)::BIGINT AS n FROM lineitem GROUP BY 1)"


@query(f"""WITH {_BASES} SELECT l_orderkey, base AS identity, base - 5000 AS subtract, least(base, 10000000) AS cap, greatest(base, 10000000) AS floor, CASE WHEN n <= 100 THEN (2 * base::HUGEINT * n + 100) // 200 END::BIGINT AS ratio,
 CASE WHEN n <= 100 THEN (2 * base::HUGEINT * n + 100) // 200 END::BIGINT AS percentage, greatest(base - 8000000, 0) AS threshold FROM b""")
def cal01_operations(spark, sf):
    """The closed set of operations over order totals; ratios and percentages above one whole are refused."""
    b = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("base")).withColumn("n", F.col("l_orderkey") % 120)
    op = lambda name, **p: money.apply_operation(name, F.col("base"), **p)
    v = lambda x: F.lit(x).cast("bigint")
    return b.select("l_orderkey", op("identity").alias("identity"), op("subtract", amount=v(5000)).alias("subtract"), op("cap", limit=v(10_000_000)).alias("cap"), op("floor", limit=v(10_000_000)).alias("floor"),
                    op("multiply_ratio", num=F.col("n"), den=v(100)).alias("ratio"), op("percentage", num=F.col("n"), den=v(1)).alias("percentage"), op("threshold", limit=v(8_000_000)).alias("threshold"))


@query(f"WITH {_BASES} SELECT l_orderkey, CASE WHEN n > 100 THEN 'RATIO_OUT_OF_RANGE' END AS error FROM b")
def cal03_ratio_range(spark, sf):
    b = table(spark, sf, "lineitem").select("l_orderkey").distinct().withColumn("n", F.col("l_orderkey") % 120)
    return b.select("l_orderkey", F.when(money.apply_operation("multiply_ratio", F.lit(1).cast("bigint"), num=F.col("n"), den=F.lit(100).cast("bigint")).isNull(), "RATIO_OUT_OF_RANGE").alias("error"))


_EV = "e AS (SELECT user_id, event_id, cast(round(value * 100) AS HUGEINT) AS w FROM events WHERE value > 0), a AS (SELECT *, sum(w) OVER (PARTITION BY user_id) AS total FROM e)"


@query(f"WITH {_EV}, b AS (SELECT *, (w * 10000) // total AS f, (w * 10000) % total AS r FROM a WHERE total > 0), c AS (SELECT *, 10000 - sum(f) OVER (PARTITION BY user_id) AS rest, row_number() OVER (PARTITION BY user_id ORDER BY r DESC, event_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM b) SELECT user_id, event_id, (f + CASE WHEN n <= rest THEN 1 ELSE 0 END)::BIGINT AS share FROM c WHERE k = 1")
def win09_first_share(spark, sf):
    """The share of each user's first event."""
    from ledgerloom.operators.records import apportion

    rows = table(spark, sf, "events").where("value > 0").select("user_id", "event_id", F.round(F.col("value") * 100).cast("bigint").alias("w")).where("w > 0")
    return apportion(rows, "user_id", "event_id", "w", 10_000).groupBy("user_id").agg(F.min(F.struct("event_id", "share")).alias("x")).select("user_id", "x.event_id", "x.share")


@query("""WITH h AS (SELECT l_orderkey, l_returnflag AS head, sum(cast(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS amount FROM lineitem GROUP BY 1, 2), t AS (SELECT *, (amount::HUGEINT * 3) // 8 AS part, sum(amount) OVER (PARTITION BY l_orderkey) AS total FROM h),
 r AS (SELECT *, (total * 3) // 8 + l_orderkey % 3 - sum(part) OVER (PARTITION BY l_orderkey) AS rest, row_number() OVER (PARTITION BY l_orderkey ORDER BY amount DESC, head) AS n FROM t) SELECT l_orderkey, head, (part + CASE WHEN n <= abs(rest) THEN sign(rest) ELSE 0 END)::BIGINT AS cut FROM r""")
def win10_ratio_lines(spark, sf):
    """A cut of three eighths, off by a few paise, spread over an order's heads: truncated parts, then a paisa each to the largest heads until the stated cut is met or every head has had one."""
    from ledgerloom.operators.records import spread_ratio

    h = table(spark, sf, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("head")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("amount"))
    stated = h.groupBy("l_orderkey").agg(F.sum("amount").alias("t")).select("l_orderkey", (F.floor(F.col("t") * 3 / 8) + F.col("l_orderkey") % 3).cast("bigint").alias("stated"))
    return spread_ratio(h.join(stated, "l_orderkey"), "l_orderkey", "head", "amount", "stated", 3, 8)


@query("SELECT l_orderkey, sum(round(l_quantity)::BIGINT)::BIGINT || '/' || count(*) * 7 AS shown FROM lineitem GROUP BY 1")
def sec27_fractions(spark, sf):
    r = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(F.round("l_quantity").cast("bigint")).alias("n"), (F.count(F.lit(1)) * 7).alias("d"))
    return r.select("l_orderkey", F.concat_ws("/", "n", "d").alias("shown"))
