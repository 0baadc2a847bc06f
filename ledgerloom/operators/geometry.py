"""Lines of a page from the places of its characters or words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def characters_to_lines(chars: DataFrame, page: str = "page") -> DataFrame:
    """page, line_no, line of characters (page, ch, x0, y0, x1, y1).

    Characters from top to bottom are cut into lines where the vertical centre moves by more than 0.6 of the page's median glyph height (1.2 at least), each line is put in order
    from left to right, and a gap wider than 0.55 of the median width (1.5 at least) is a space. Runs of blanks are one, blank lines none. Null characters and boxes are left
    out. The windows are over one page."""
    c = chars.where("ch <> '' and x0 is not null and y0 is not null and x1 is not null and y1 is not null")
    size = c.groupBy(page).agg(F.median(F.when(F.col("y1") > F.col("y0"), F.col("y1") - F.col("y0"))).alias("__h"), F.median(F.when((F.col("x1") > F.col("x0")) & (F.col("x1") - F.col("x0") < 40), F.col("x1") - F.col("x0"))).alias("__w"))
    c = c.join(size, page).withColumn("__y", (F.col("y0") + F.col("y1")) / 2)
    down = W.partitionBy(page).orderBy(F.desc("__y"), "x0", "ch")
    step = F.when(F.abs(F.col("__y") - F.lag("__y").over(down)) <= F.greatest(F.lit(1.2), 0.6 * F.coalesce("__h", F.lit(2.0))), 0).otherwise(1)
    c = c.withColumn("__new", step).withColumn("__line", F.sum("__new").over(down.rowsBetween(W.unboundedPreceding, 0)))
    along = W.partitionBy(page, "__line").orderBy("x0", "ch")
    c = c.withColumn("__gap", (F.col("x0") - F.lag("x1").over(along)) > F.greatest(F.lit(1.5), 0.55 * F.coalesce("__w", F.lit(2.0))))
    part = F.when(F.col("__gap"), F.concat(F.lit(" "), "ch")).otherwise(F.col("ch"))
    lines = c.groupBy(page, "__line").agg(F.array_sort(F.collect_list(F.struct("x0", "ch", part.alias("part")))).alias("__parts"))  # one line of a page
    lines = lines.withColumn("line", F.trim(F.regexp_replace(F.array_join("__parts.part", ""), r"[ \t]{2,}", " "))).where("line <> ''")
    return lines.select(page, F.row_number().over(W.partitionBy(page).orderBy("__line")).cast("bigint").alias("line_no"), "line")


def words_to_lines(words: DataFrame, page: str = "page", scale: float = 1.0) -> DataFrame:
    """page, line_no, line, x0, y0, x1, y1, confidence of recognised words (page, block, par, line, word, confidence, left, top, width, height, page_height).

    Words of one block, paragraph and line are put in order from left to right; image places run downwards, so they are turned round; the confidence is the mean of those not negative,
    as a share. Blank words are left out."""
    w = words.where("trim(word) <> ''").withColumn("word", F.trim("word"))
    g = w.groupBy(page, "block", "par", "line").agg(
        F.array_sort(F.collect_list(F.struct("left", "top", "word"))).alias("__w"), F.min("left").alias("l"), F.max(F.col("left") + F.col("width")).alias("r"), F.min("top").alias("t"), F.max(F.col("top") + F.col("height")).alias("b"),
        F.max("page_height").alias("h"), F.avg(F.when(F.col("confidence") >= 0, F.col("confidence") / 100)).alias("confidence"),
    )
    at = F.row_number().over(W.partitionBy(page).orderBy("block", "par", "line")).cast("bigint")
    return g.select(page, at.alias("line_no"), F.array_join("__w.word", " ").alias("line"), (F.col("l") / scale).alias("x0"), (F.col("h") - F.col("b") / scale).alias("y0"), (F.col("r") / scale).alias("x1"), (F.col("h") - F.col("t") / scale).alias("y1"), "confidence")
