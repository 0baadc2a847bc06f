"""Equi-joins in which one key may hold a large share of the big side's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.session import cut

#: A key with more than 1/HOT_SHARE of the rows is salted. Fewer than HOT_SHARE keys can have that many, so the list that is
#: broadcast is bounded whatever the data.
HOT_SHARE = 1_000
SALTS = 64
LEAST = 1_000


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """key, __hot: the keys with more than 1/HOT_SHARE of the rows, fewer than HOT_SHARE; counted with a map-side part and written once."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n")).select(F.col("sum(__n)").alias("__all"))
    return cut(counts.where(F.col("__n") > LEAST).join(F.broadcast(total), F.col("__n") * HOT_SHARE > F.col("__all")).select(key, F.lit(True).alias("__hot")), "hot")


def salted_join(big: DataFrame, small: DataFrame, key: str, salts: int = SALTS) -> DataFrame:
    """Inner join of big and small on the string or integer column key. The rows of hot keys in big are spread over salts by the hash of
    the row, so that a task run again spreads them alike, and small's rows of these keys are repeated once a salt; all other rows are shuffled as
    usual. Null keys join nothing."""
    hot = F.broadcast(hot_keys(big, key))
    row = F.xxhash64(*[f.name for f in big.schema if not isinstance(f.dataType, T.MapType)])
    left = big.join(hot, key, "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(row, F.lit(salts))).otherwise(0).cast("int")).drop("__hot")
    spread = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = small.join(hot, key, "left").withColumn("__salt", F.explode(spread)).drop("__hot")
    return left.join(right, [key, "__salt"]).drop("__salt")
