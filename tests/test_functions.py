import random
from fractions import Fraction

from pyspark.sql import functions as F

from ledgerloom.functions import money, text as tx


def column(spark, values, kind, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_tokens(spark):
    cases = {"1,180.00": ("strict_decimal", 118000), "350,00": ("decimal_comma", None), "1,50,000": ("grouped_integer", 15000000), "350": ("plain_integer", 35000), "1,5,0.00": ("malformed", None), "12.5": ("strict_decimal", 1250)}
    assert column(spark, list(cases), "string", money.token_class) == [k for k, _ in cases.values()]
    assert column(spark, list(cases), "string", money.token_paise) == [p for _, p in cases.values()]


def test_grouping(spark):
    cases = {"1500": "plain", "1,500": "ambiguous_equal", "1,83,500": "indian", "1,183,500": "western", "1,50": "invalid", "1234,500": "invalid"}
    assert column(spark, list(cases), "string", money.grouping_style) == list(cases.values())


def test_half_up(spark):
    r = random.Random(4)
    rows = [(r.randrange(-(10**12), 10**12), r.randrange(0, 10**6), r.randrange(1, 10**6)) for _ in range(300)] + [(5, 1, 2), (-5, 1, 2), (0, 1, 3)]
    got = [x.o for x in spark.createDataFrame(rows, "a bigint, n bigint, d bigint").select(money.half_up(F.col("a"), F.col("n"), F.col("d")).alias("o")).collect()]
    want = [(1 if a >= 0 else -1) * int(abs(Fraction(a) * n / d) + Fraction(1, 2)) for a, n, d in rows]
    assert got == want


def test_words_and_display(spark):
    n = [0, 7, 19, 20, 99, 100, 1_000, 183_500, 10_000_000, 123_45_67_890, 999_99_99_999]
    words = column(spark, n, "bigint", money.in_words)
    assert words[7] == "one lakh eighty three thousand five hundred"
    assert column(spark, words, "string", money.from_words) == n
    assert column(spark, ["Rupees One Lakh Only", "one banana", "", None], "string", money.from_words) == [100_000, None, None, None]
    assert column(spark, [12345678, -5, 100000, 99999999999], "bigint", money.format_inr) == ["1,23,456.78", "-0.05", "1,000.00", "99,99,99,999.99"]


def test_ocr(spark):
    assert column(spark, ["l,OOO", "Solo", "12S", "abc", "1,000", ""], "string", money.repaired_digits) == ["1,000", "Solo", "125", "abc", "1,000", ""]


def test_text(spark):
    assert column(spark, ["Rs 1,234.50 and 7.", "none", None], "string", tx.numeric_signature) == [["1234.50", "7"], [], None]
    assert column(spark, ["You shall NOT pay unless no", ""], "string", tx.bearing_signature) == [["no", "not", "shall", "unless"], []]
    assert column(spark, ["write to a.b@c.in or 9876543210"], "string", tx.redacted) == ["write to <EMAIL> or <MOBILE>"]
    assert [str(x) for x in column(spark, ["2019-01-18", "16/09/2019", "22 May 2018", "31/02/2019", "soon", None], "string", tx.iso_date)] == ["2019-01-18", "2019-09-16", "2018-05-22", "None", "None", "None"]
