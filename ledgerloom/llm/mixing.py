"""Mixing sources to target shares of tokens.

Documents are counted in cells of source, language and topic. Iterative proportional fitting rakes the cells' tokens to the sources' targets and to
the languages' and topics' own shares, no cell above its source's cap; the sources come last in each round, so their
targets hold where the three can't all be met. A document is then expected to be used as often as its cell's tokens were multiplied. Its whole part
is certain; documents enter by order sampling for the rest: each has a fixed random number divided by its probability, its key, and those
below their source's threshold are taken; keys k are placed at k / (1 + k), below 1. Thresholds come from histograms of these keys, so that the tokens drawn meet the
target to within a few documents, and nothing is sorted or gathered.

Up to MOST_CELLS cells are raked as arrays on the driver; more are raked as a table, by the same steps and as many, so the rates are the same but for the
rounding of doubles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.bpe import DEFAULT_PATH, encoder
from ledgerloom.llm.quality import language_of
from ledgerloom.operators.skew import salted_join
from ledgerloom.session import cut

ROUNDS = 50
MOST_CELLS = 100_000  # so many cells are raked on the driver and their rates broadcast
TABLE_ROUNDS, CLOSE = ROUNDS, 1e-12  # rounds of raking a table, as many as on the driver; how near its sources come to their targets
BINS = 4_096
FILL_ROUNDS = 4


def source_key(c):
    """Spellings differ in case, underscores and spaces only."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"^[\s_]+|[\s_]+$", ""), r"[\s_]+", "_"))


def _rake(sources: np.ndarray, langs: np.ndarray, topics: np.ndarray, tokens: np.ndarray, target: np.ndarray, cap: np.ndarray) -> np.ndarray:
    """How often each cell's tokens are to be used. target: tokens of each source; cap: the most uses of each source."""
    total, w = target.sum(), np.ones(len(tokens))
    limit = cap[sources]
    own = [(g, np.bincount(g, tokens) / tokens.sum() * total) for g in (langs, topics)]
    for _ in range(ROUNDS):
        for g, want in own:
            have = np.bincount(g, w * tokens, len(want))
            w = np.minimum(limit, w * np.divide(want, have, out=np.ones_like(want), where=have > 0)[g])
        for s in range(len(target)):
            i = np.flatnonzero(sources == s)
            if not len(i) or target[s] <= 0:
                w[i] = 0
                continue
            w[i] = np.maximum(w[i], 1e-9)
            low, high = 0.0, 1.0
            use = lambda k: (np.minimum(cap[s], k * w[i]) * tokens[i]).sum()  # noqa: B023, E731
            while use(high) < target[s] * (1 - 1e-12) and high < 1e15:
                high *= 2
            for _ in range(80):
                mid = (low + high) / 2
                low, high = (mid, high) if use(mid) < target[s] else (low, mid)
            w[i] = np.minimum(cap[s], high * w[i])
    return w


def _rake_table(cells: DataFrame, goals: DataFrame) -> DataFrame:
    """source, language, topic, rate: what _rake does, with the cells as a table. goals: source, cap, target (tokens); a row per listed source."""
    w = cut(cells.join(F.broadcast(goals), "source").where("target > 0").withColumn("rate", F.lit(1.0)), "rake")
    total = goals.agg(F.sum("target")).first()[0] or 0.0
    every = w.agg(F.sum("tokens")).first()[0] or 1

    def towards(w: DataFrame, key: str, want) -> DataFrame:
        have = w.groupBy(key).agg(F.sum(F.col("rate") * F.col("tokens")).alias("have"), want.alias("want"))
        return w.join(have, key).withColumn("rate", F.least("cap", F.col("rate") * F.col("want") / F.col("have"))).drop("have", "want")

    def to_sources(w: DataFrame) -> DataFrame:
        mass, at_cap = F.col("rate") * F.col("tokens"), F.col("rate") >= F.col("cap")
        have = w.groupBy("source").agg(F.sum(F.when(at_cap, mass).otherwise(0.0)).alias("full"), F.sum(F.when(at_cap, 0.0).otherwise(mass)).alias("open"))
        full, some = F.col("full"), F.col("open")
        up = F.when(at_cap, F.col("rate")).otherwise(F.col("rate") * F.try_divide(F.col("target") - full, some))
        rate = F.when(full + some > F.col("target"), F.col("rate") * F.col("target") / (full + some)).otherwise(up)
        return w.join(F.broadcast(have), "source").withColumn("rate", F.least("cap", rate)).drop("full", "open")  # a row per target

    own = F.sum("tokens") / float(every) * float(total)
    for _ in range(TABLE_ROUNDS):
        w, short = towards(towards(w, "language", own), "topic", own).withColumn("rate", F.greatest("rate", F.lit(1e-9))), 1
        while short:  # where cells reach their cap, the others of their source make up for them; each time at least one more does
            w = cut(to_sources(w), "rake")
            free = F.max(F.col("rate") < F.col("cap"))
            short = w.groupBy("source").agg(F.sum(F.col("rate") * F.col("tokens")).alias("have"), F.max("target").alias("want"), free.alias("free")).where(f"free and have < want * (1 - {CLOSE})").limit(1).count()
    return w.select("source", "language", "topic", "rate")


def counted(docs: DataFrame, targets: DataFrame, tokenizer: str = DEFAULT_PATH) -> DataFrame:
    """doc_id, source, language, topic, tokens of the documents that can be drawn: those of listed sources that have tokens. The issuer stands for the
    topic. Texts are read once."""
    listed = F.broadcast(targets.select(source_key(F.col("source")).alias("source")).distinct())  # one row per target
    rows = docs.select("doc_id", source_key(F.col("source")).alias("source"), F.coalesce("issuer", F.lit("(none)")).alias("topic"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for rb in batches:
            texts = [t or "" for t in rb.column(4).to_pylist()]
            languages = [language_of(a, t) for a, t in zip(rb.column(3).to_pylist(), texts)]
            sizes = [len(enc.encode(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(languages, pa.string()), rb.column(2), pa.array(sizes, pa.int64())], names=["doc_id", "source", "language", "topic", "tokens"])

    kept = rows.where("text <> ''").join(listed, "source").select("doc_id", "source", "topic", "lang", "text")
    return cut(kept.mapInArrow(run, "doc_id bigint, source string, language string, topic string, tokens bigint").where("tokens > 0"), "sized")


def draw(docs: DataFrame, targets: DataFrame, tokenizer: str = DEFAULT_PATH) -> tuple[DataFrame, list[dict]]:
    """(doc_id, source, language, topic, tokens, uses of each document that can be drawn, and the targets by source).

    The total is the largest for which every source with a target and documents can meet its share within its cap. Sources that aren't listed, null
    sources and documents without tokens take no part; a listed source without any tokens can't contribute, and the other shares are
    scaled up. Null or negative targets and caps count as 0. Draws are fixed by doc_id: the same input gives the same draw."""
    sized = counted(docs, targets, tokenizer)
    goals: dict[str, dict] = {}
    for r in targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").collect():
        if r["source"]:
            goals[r["source"]] = {"source": r["source"], "target_share": max(0.0, r["target_share"] or 0.0), "max_repeats": max(0, r["max_repeats"] or 0)}
    cells = cut(sized.groupBy("source", "language", "topic").agg(F.sum("tokens").alias("tokens")), "cells")
    names = sorted(goals)
    available = {r["source"]: r["t"] for r in cells.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}  # a row per target
    for s in names:
        goals[s]["available"] = int(available.get(s, 0))
    able = [s for s in names if goals[s]["available"] * goals[s]["max_repeats"] * goals[s]["target_share"] > 0]
    total = min((goals[s]["max_repeats"] * goals[s]["available"] / goals[s]["target_share"] for s in able), default=0.0) * sum(goals[s]["target_share"] for s in able)
    share = sum(goals[s]["target_share"] for s in able)
    for s in names:
        goals[s]["target_tokens"] = total * goals[s]["target_share"] / share if s in able else 0.0
    spark, few = sized.sparkSession, cells.count() <= MOST_CELLS
    if few:
        table = cells.orderBy("source", "language", "topic").toPandas()
        if len(table) and able:
            code = {s: k for k, s in enumerate(names)}
            as_codes = lambda c: np.unique(table[c], return_inverse=True)[1]
            target, cap = (np.array([goals[s][k] for s in names], float) for k in ("target_tokens", "max_repeats"))
            table["rate"] = _rake(table.source.map(code).to_numpy(), as_codes("language"), as_codes("topic"), table.tokens.to_numpy(float), target, cap)
        else:
            table["rate"] = 0.0
        rates = spark.createDataFrame([(str(r.source), str(r.language), str(r.topic), float(r.rate)) for r in table.itertuples()], "source string, language string, topic string, rate double")
        rated = sized.join(F.broadcast(rates), ["source", "language", "topic"])  # at most MOST_CELLS rows
    else:
        goal = spark.createDataFrame([(s, float(goals[s]["max_repeats"]), goals[s]["target_tokens"]) for s in names], "source string, cap double, target double")
        cell = lambda df: df.withColumn("cell", F.concat_ws("\x1f", "source", "language", "topic"))
        rated = salted_join(cell(sized), cell(_rake_table(cells, goal)).select("cell", "rate"), "cell").drop("cell")
    u = (F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    rest = F.col("rate") - F.floor("rate")
    keyed = cut(
        rated.withColumn("sure", F.floor("rate"))
        .withColumn("key", F.when(rest > 1e-12, F.try_divide(u, rest)))
        .select("doc_id", "source", "language", "topic", "tokens", "sure", (F.col("key") / (F.col("key") + 1)).alias("place")),
        "keyed",
    )
    taken = _thresholds(keyed, {s: goals[s]["target_tokens"] for s in names})
    limits = spark.createDataFrame(list(taken.items()), "source string, taken array<struct<a:double,b:double,m:double>>")
    fits = F.exists("taken", lambda x: (F.col("place") >= x["a"]) & (F.col("place") < x["b"]) & (F.col("tokens") <= x["m"]))
    drawn = keyed.join(F.broadcast(limits), "source").select("doc_id", "source", "language", "topic", "tokens", (F.col("sure") + F.when(fits, 1).otherwise(0)).cast("int").alias("uses"))
    return drawn, [goals[s] for s in names]


def _thresholds(keyed: DataFrame, target: dict[str, float]) -> dict[str, list[tuple[float, float, float]]]:
    """Per source the ranges of places from which documents up to so many tokens are taken.

    A histogram of the tokens over the places, and one of the bin in which the target is met, give the first range. What is missing then is less
    than the document met next: further rounds go on behind it, with documents that still fit."""
    if not target:
        return {}
    sure = {r["source"]: r["t"] for r in keyed.groupBy("source").agg(F.sum(F.col("sure") * F.col("tokens")).alias("t")).collect()}
    need = {s: max(0.0, t - sure.get(s, 0)) for s, t in target.items()}
    at, taken = dict.fromkeys(target, 0.0), {s: [] for s in target}
    for turn in range(FILL_ROUNDS):
        most = {s: float("inf") if turn == 0 else need[s] for s in target}
        bounds = {s: (at[s], 1.0 - at[s]) for s in target if need[s] >= 1 and at[s] < 1}
        begin, got = dict(at), dict.fromkeys(bounds, 0.0)
        for _ in range(2):
            if not bounds:
                break
            ranges = keyed.sparkSession.createDataFrame([(s, a, w, most[s]) for s, (a, w) in bounds.items()], "source string, a double, w double, m double")
            inside = keyed.join(F.broadcast(ranges), "source").where("place >= a and tokens <= m").withColumn("bin", F.floor((F.col("place") - F.col("a")) / F.col("w") * BINS)).where(f"bin < {BINS}")
            hist: dict[str, dict[int, int]] = {}
            for r in inside.groupBy("source", "bin").agg(F.sum("tokens").alias("t")).collect():  # at most sources x BINS rows
                hist.setdefault(r["source"], {})[r["bin"]] = r["t"]
            for s, (a, w) in bounds.items():
                k = 0
                while k < BINS and got[s] + hist.get(s, {}).get(k, 0) <= need[s]:
                    got[s] += hist.get(s, {}).get(k, 0)
                    k += 1
                bounds[s] = (a + k * w / BINS, w / BINS)
        for s, (a, w) in bounds.items():
            taken[s].append((begin[s], a, most[s]))
            need[s] -= got[s]
            at[s] = a + w
    return taken


def mix_report(docs: DataFrame, targets: DataFrame, tokenizer: str = DEFAULT_PATH) -> DataFrame:
    """source, target_share, max_repeats, tokens_available, tokens_drawn, share_reached, documents_drawn, repeats_used for each listed source."""
    drawn, goals = draw(docs, targets, tokenizer)
    spark = docs.sparkSession
    goal = spark.createDataFrame([(g["source"], g["target_share"], g["max_repeats"], g["available"]) for g in goals], "source string, target_share double, max_repeats int, tokens_available bigint")
    got = drawn.where("uses > 0").groupBy("source").agg(F.sum(F.col("uses") * F.col("tokens")).alias("tokens_drawn"), F.count(F.lit(1)).alias("documents_drawn"), F.max("uses").alias("repeats_used"))
    got = cut(got, "drawn")  # a row per source
    total = got.agg(F.sum("tokens_drawn").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return goal.join(got, "source", "left").join(F.broadcast(total), F.lit(True), "left").select(
        "source", "target_share", "max_repeats", "tokens_available", zero("tokens_drawn").cast("bigint").alias("tokens_drawn"),
        F.coalesce(zero("tokens_drawn") / F.nullif("total", F.lit(0)), F.lit(0.0)).alias("share_reached"),
        zero("documents_drawn").cast("bigint").alias("documents_drawn"), zero("repeats_used").cast("int").alias("repeats_used"),
    )


def mix_marginals(docs: DataFrame, targets: DataFrame, tokenizer: str = DEFAULT_PATH) -> DataFrame:
    """marginal (source, language, topic), value, own_share (of the tokens that can be drawn), share_reached (of those drawn)."""
    drawn = draw(docs, targets, tokenizer)[0]
    kinds = F.array(*[F.struct(F.lit(k).alias("marginal"), F.col(k).alias("value")) for k in ("source", "language", "topic")])
    rows = drawn.select(F.inline(kinds), "tokens", (F.col("uses") * F.col("tokens")).alias("used")).groupBy("marginal", "value").agg(F.sum("tokens").alias("own"), F.sum("used").alias("used"))
    rows = cut(rows, "marginals")
    whole = rows.where("marginal = 'source'").agg(F.sum("own").alias("all_own"), F.sum("used").alias("all_used"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return rows.join(F.broadcast(whole)).select("marginal", "value", share("own", "all_own").alias("own_share"), share("used", "all_used").alias("share_reached"))
