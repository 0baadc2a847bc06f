"""Keyed records: latest state, registries, pages of a list, quantiles, shares, signatures of sets."""

from __future__ import annotations

import base64
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the order columns (nulls first), as one aggregation with a map-side part: no window, no sort. Equal rows
    in all order columns are decided by the remaining columns, so the result is the same however the rows lie."""
    rest = [c for c in rows.columns if c not in keys]
    ordered = order + [c for c in rest if c not in order]
    top = rows.groupBy(*keys).agg(F.max(F.struct(*ordered)).alias("__top"))
    return top.select(*keys, *[F.col("__top")[c].alias(c) for c in rest])


def registry(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """content_id, first_id, copies, chars: one row per different text; a null text is no content."""
    return docs.where(F.col(text).isNotNull()).groupBy(F.sha2(F.col(text), 256).alias("content_id")).agg(F.min(doc_id).alias("first_id"), F.count(F.lit(1)).alias("copies"), F.max(F.length(text)).cast("bigint").alias("chars"))


def keyset_page(rows: DataFrame, order: list[str], size: int, after: tuple | None = None) -> DataFrame:
    """The page of `size` rows, newest first, that follows the row whose order columns are `after`. The bound goes into the scan's filter, and
    only size rows of each task are kept."""
    if after is not None:
        below, equal = F.lit(False), F.lit(True)
        for c, v in zip(order, after):
            below = below | (equal & (F.col(c) < F.lit(v)))
            equal = equal & (F.col(c) == F.lit(v))
        rows = rows.where(below)
    return rows.orderBy(*[F.desc(c) for c in order]).limit(size)


def encode_cursor(*values: str) -> str:
    return base64.urlsafe_b64encode(json.dumps(values, separators=(",", ":")).encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> tuple:
    """The values; ValueError for anything longer than 512 characters or malformed."""
    if len(cursor) > 512:
        raise ValueError("cursor too long")
    try:
        values = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except Exception as e:
        raise ValueError("malformed cursor") from e
    if not isinstance(values, list):
        raise ValueError("malformed cursor")
    return tuple(values)


def cursor_column(*cols: Column) -> Column:
    """encode_cursor over string columns, in the JVM, for values that JSON doesn't escape."""
    body = F.concat(F.lit('["'), F.concat_ws('","', *cols), F.lit('"]'))
    return F.regexp_replace(F.translate(F.base64(body.cast("binary")), "+/", "-_"), "=+$", "")


def decoded_cursor(cursor: Column, fields: int) -> Column:
    """struct<values, error> of a cursor of `fields` strings, in the JVM: INVALID_CURSOR for more than 512 characters, for what is no URL-safe base64, and for anything but a list of so
    many strings."""
    plain = F.translate(cursor, "-_", "+/")
    ok = (F.length(cursor) <= 512) & cursor.rlike(r"^[A-Za-z0-9_-]+$") & (F.length(cursor) % 4 != 1)
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))
    values = F.from_json(F.decode(F.unbase64(F.when(ok, padded)), "UTF-8"), "array<string>")
    good = F.coalesce(F.size(values) == fields, F.lit(False))
    return F.struct(F.when(good, values).alias("values"), F.when(~good, "INVALID_CURSOR").alias("error"))


def fold_steps(rows: DataFrame, group: str, order: list[str], op: str, amount: str, start: Column) -> DataFrame:
    """group, result: `start` carried through each group's steps in order: subtract, cap, floor, anything else leaves it. Order matters, so the steps of one group are one array."""
    steps = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(op).alias("__op"), F.col(amount).alias("__v")))).alias("__steps"))
    move = lambda a, x: F.when(x["__op"] == "subtract", a - x["__v"]).when(x["__op"] == "cap", F.least(a, x["__v"])).when(x["__op"] == "floor", F.greatest(a, x["__v"])).otherwise(a)
    return steps.select(group, F.aggregate("__steps", start, move).alias("result"))


def index_quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per key the values at index int(share * n) of the sorted values (the last for share 1), by name, without interpolation. Works on counts of
    different values, so equal values and large groups cost nothing extra. Null values aren't counted."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    w = W.partitionBy(*keys).orderBy(value)
    run = counts.withColumn("__upto", F.sum("__n").over(w)).withColumn("__all", F.sum("__n").over(W.partitionBy(*keys)))
    at = lambda q: F.least(F.floor(F.lit(q) * F.col("__all")), F.col("__all") - 1)
    return run.groupBy(*keys).agg(F.max("__all").alias("n"), *[F.min(F.when(F.col("__upto") > at(q), F.col(value))).alias(name) for name, q in shares.items()])


def apportion(rows: DataFrame, group: str, row_id: str, weight: str, total: int) -> DataFrame:
    """group, row_id, share: `total` handed out in proportion to whole weights, exactly: floors first, then one each to the largest remainders, ties to
    the smaller row_id. Groups whose weights sum to 0 get 0. The window is over one group's rows; groups of a size that one task can't sort
    need a coarser group."""
    w = W.partitionBy(group)
    base = rows.select(group, row_id, F.col(weight).cast("decimal(38,0)").alias("__w")).withColumn("__all", F.sum("__w").over(w))
    scaled = base.withColumn("__p", (F.col("__w") * F.lit(total)).cast("decimal(38,0)")).withColumn("__floor", F.when(F.col("__all") > 0, F.floor(F.col("__p") / F.col("__all")).cast("bigint")).otherwise(0))
    rem = scaled.withColumn("__rem", F.col("__p") - F.col("__floor") * F.col("__all")).withColumn("__left", F.when(F.col("__all") > 0, F.lit(total) - F.sum("__floor").over(w)).otherwise(0))
    rank = F.row_number().over(w.orderBy(F.desc("__rem"), row_id))
    return rem.select(group, row_id, (F.col("__floor") + F.when(rank <= F.col("__left"), 1).otherwise(0)).cast("bigint").alias("share"))


def spread_ratio(rows: DataFrame, group: str, item: str, amount: str, stated: str, num: int, den: int) -> DataFrame:
    """group, item, cut: each amount times num/den, truncated; what the parts lack of the group's `stated` cut, or have too much, goes in steps of one to the items with the
    largest amounts (ties to the smaller item), at most one step each. The window is over one group's items."""
    w = W.partitionBy(group)
    part = rows.withColumn("__part", F.floor((F.col(amount).cast("decimal(38,0)") * num).cast("decimal(38,0)") / den).cast("bigint"))
    off = part.withColumn("__off", F.col(stated) - F.sum("__part").over(w)).withColumn("__n", F.row_number().over(w.orderBy(F.desc(amount), item)))
    step = F.when(F.col("__n") <= F.abs("__off"), F.signum("__off").cast("bigint")).otherwise(0)
    return off.select(group, item, (F.col("__part") + step).cast("bigint").alias("cut"))


def agreement(readings: DataFrame) -> DataFrame:
    """subject, agreement, disposition, paise of readings (subject, reader, paise): agree and USABLE where at least two readers read the same amount,
    and no other; one_reader or disagree and QUARANTINED; no_reading and EVIDENCE_GAP where none read one."""
    g = readings.groupBy("subject").agg(F.count("paise").alias("n"), F.countDistinct("paise").alias("kinds"), F.min("paise").alias("paise"))
    how = F.when(F.col("n") == 0, "no_reading").when(F.col("kinds") > 1, "disagree").when(F.col("n") == 1, "one_reader").otherwise("agree")
    state = F.when(how == "agree", "USABLE").when(how == "no_reading", "EVIDENCE_GAP").otherwise("QUARANTINED")
    return g.select("subject", how.alias("agreement"), state.alias("disposition"), F.when(how == "agree", F.col("paise")).alias("paise"))


def set_hash(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, set_hash, members: a hash of the set of texts of each key that doesn't depend on their order. Null texts are left out."""
    digests = rows.where(F.col(text).isNotNull()).select(key, F.sha2(text, 256).alias("d")).distinct()
    return digests.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ","), 256).alias("set_hash"), F.count(F.lit(1)).alias("members"))


def text_lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no (from 1), char_start, char_end, line: the lines of each text and where they stand in it."""
    w = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    lines = rows.where(F.col(text).isNotNull()).dropDuplicates([key]).select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    start = F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0))
    return lines.select(key, (F.col("pos") + 1).cast("bigint").alias("line_no"), start.cast("bigint").alias("char_start"), (start + F.length("line")).cast("bigint").alias("char_end"), "line")


def align_lines(left: DataFrame, right: DataFrame, window: int = 6, least: float = 0.55) -> DataFrame:
    """page, left_no, right_no, score: the lines of two readings of a page (page, line_no, line) matched in order. Each left line takes the best of the
    next `window` right lines if it is alike enough, and the search goes on behind it: an order-dependent walk, so a page is one task's work. Lines
    without a match have null."""

    def walk(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        from difflib import SequenceMatcher

        rights, at, out = b.sort_values("line_no"), 0, []
        texts, numbers = rights["line"].tolist(), rights["line_no"].tolist()
        for no, line in a.sort_values("line_no")[["line_no", "line"]].itertuples(index=False):
            best, score = -1, least
            for k in range(at, min(len(texts), at + window)):
                m = SequenceMatcher(None, line, texts[k], autojunk=False)
                if m.real_quick_ratio() >= score and m.quick_ratio() >= score and (r := m.ratio()) >= score and (r > score or best < 0):
                    best, score = k, r
            out.append((key[0], no, numbers[best] if best >= 0 else None, round(score, 6) if best >= 0 else None))
            at = best + 1 if best >= 0 else at
        return pd.DataFrame(out, columns=["page", "left_no", "right_no", "score"]).astype({"right_no": "Int64"})

    # new names, so that two readings made of one frame stay apart
    left, right = (df.select(*[F.col(c).alias(c) for c in ("page", "line_no", "line")]) for df in (left, right))
    return left.groupBy("page").cogroup(right.groupBy("page")).applyInPandas(walk, "page string, left_no bigint, right_no bigint, score double")
