"""Long exact spans shared between records, by relative Lempel-Ziv parsing.

Every record is factored against all others. The reference, the whole collection, is indexed by its windows of LEAST characters, and the index is cut
into blocks by the window's hash: an entry is a window and where it stands, whatever number of records hold it. A record is parsed from left to right against every block
that can answer: in each window the k-gram with the smallest hash is its anchor, equal windows have equal anchors, and where an anchor stands in one record only the
text is literal and skipped. A window found in a block gives the factor's source, a place in another record, and the factor goes on as long
as the windows that follow have the same source at the same distance. Factors are checked at their boundaries: every window that reaches
over the end of a factor has been looked up itself, so a match is never lost because a factor began or ended inside it. At last each
factor is compared with its source character by character. Hashes of 128 bits only choose what is compared; should a comparison fail, the parse is made
again with other hashes.

To tell only which records share, the index is sampled: one window in STRIDE, chosen by its hash, is looked up first; longer factors show
there. For the records still open, the windows they may share, and those alone, are looked up in full, in all records.

Nothing is compared pair by pair. Of a passage that many records hold each batch of rows sends one or two entries a window to the index and answers its own rows
itself, so a passage in a third of all records makes as many rows under one key as there are batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.bagminhash import mix
from ledgerloom.operators.skew import salted_join
from ledgerloom.session import cut

LEAST = 200  # characters (code points) of a span
GRAM = 150  # characters of an anchor
STRIDE = 16  # one window in so many is looked up first
CHUNK = 1 << 20  # characters hashed at a time; a longer text makes its own chunk
FILTER_LOG2 = 27  # bits of a filter: always 16 MB, whatever the data; it only saves work, false hits are harmless


class _Hasher:
    """Hashes of all windows of texts laid end to end. The hash of a span is the same wherever it stands. Another seed gives other hashes."""

    def __init__(self, seed: int = 0) -> None:
        self.base = (0x9E3779B97F4A7C15 * (2 * seed + 1) % 2**64) | 1
        self.pow = self.inv = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.pow) < n:
            size = max(n, CHUNK + LEAST)
            self.pow, self.inv = np.full(size, self.base, np.uint64), np.full(size, pow(self.base, -1, 2**64), np.uint64)
            self.pow[0] = self.inv[0] = 1
            self.pow, self.inv = np.multiply.accumulate(self.pow), np.multiply.accumulate(self.inv)

    def of(self, chars: np.ndarray) -> "_Hasher":
        self._powers(len(chars))
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * self.inv[: len(chars)], dtype=np.uint64)])
        self.n = len(chars)
        return self

    def spans(self, length: int, at: np.ndarray | None = None) -> np.ndarray:
        with np.errstate(over="ignore"):
            if at is None:
                n = self.n - length + 1
                return mix((self.sums[length:] - self.sums[:n]) * self.pow[:n])
            return mix((self.sums[at + length] - self.sums[at]) * self.pow[at])


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w values in a row: prefix and suffix minima of blocks of w."""
    n = len(x)
    pad = -n % w
    y = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    left = np.minimum.accumulate(y, axis=1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def _windows(rb: pa.RecordBatch, hasher: _Hasher, least: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, _Hasher]]:
    """For chunks of texts: starts of the windows, the row each is of, its start in the text, its anchor. rb: rec, text."""
    texts = rb.column(1).to_pylist()
    row = 0
    while row < len(texts):
        parts, sizes, first, total = [], [], row, 0
        while row < len(texts) and (not parts or total + len(texts[row]) <= CHUNK):
            parts.append(texts[row])
            sizes.append(len(texts[row]))
            total += len(texts[row])
            row += 1
        chars = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = np.array(sizes)
        if len(chars) < least:
            continue
        h = hasher.of(chars)
        anchor = _window_min(h.spans(gram), least - gram + 1)
        begin = np.repeat(np.cumsum(n) - n, n)
        owner = np.repeat(np.arange(len(n)), n)
        start = np.flatnonzero(owner[: len(anchor)] == owner[least - 1 :])
        yield start, first + owner[start], start - begin[start], anchor[start], h


def _anchor_rows(texts: DataFrame, least: int, gram: int, seed: int, open_records=None, shared=None) -> DataFrame:
    """anchor, lo, hi: the anchors of each batch with the smallest and the largest record they stand in; of open records and shared anchors only, if filters
    are given."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher(seed)
        for rb in batches:
            if open_records is not None:
                rb = rb.filter(pa.array(_hit(open_records.value, rb.column(0).to_numpy(zero_copy_only=False).view(np.uint64))))
            rec = rb.column(0).to_numpy(zero_copy_only=False)
            for _, row, _, anchor, _ in _windows(rb, hasher, least, gram):
                if not len(anchor):
                    continue
                new = np.r_[True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]
                if shared is not None:
                    new &= _hit(shared.value, anchor)
                a, r = anchor[new], rec[row[new]]
                o = np.argsort(a)
                a, r = a[o], r[o]
                first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.array([], np.int64)
                lo, hi = (np.minimum.reduceat(r, first), np.maximum.reduceat(r, first)) if len(a) else (r, r)
                yield pa.RecordBatch.from_arrays([pa.array(a[first].view(np.int64)), pa.array(lo), pa.array(hi)], names=["anchor", "lo", "hi"])

    return texts.mapInArrow(anchors, "anchor bigint, lo bigint, hi bigint")


def _shared_anchors(texts: DataFrame, least: int, gram: int, seed: int) -> DataFrame:
    return _anchor_rows(texts, least, gram, seed).groupBy("anchor").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("anchor")


def _hit(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    m = np.uint64((1 << FILTER_LOG2) - 1)
    at = lambda x: (bits[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8)) & 1
    return (at(key & m) & at((key >> np.uint64(32)) & m)).astype(bool)


def _filter(keys: DataFrame):
    """A broadcast Bloom filter of fixed size with two bits per 64-bit key, put together by executors in pieces of 4 KB. A false hit costs a
    needless look-up, nothing else."""
    key = F.col(keys.columns[0])
    m = (1 << FILTER_LOG2) - 1
    bit = F.explode(F.array(key.bitwiseAND(m), F.shiftrightunsigned(key, 32).bitwiseAND(m)))
    rows = keys.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / 32768).cast("int").alias("piece")).agg(F.bitmap_construct_agg(F.pmod("bit", F.lit(32768))).alias("bits")).collect()
    out = np.zeros((1 << FILTER_LOG2) // 8, np.uint8)
    for r in rows:
        out[r["piece"] * 4096 : (r["piece"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return keys.sparkSession.sparkContext.broadcast(out)


def _only(texts: DataFrame, wanted) -> DataFrame:
    """The rows of texts whose rec is in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            yield rb.filter(pa.array(_hit(wanted.value, rb.column(0).to_numpy(zero_copy_only=False).view(np.uint64))))

    return texts.mapInArrow(run, texts.schema)


_ALL, _FIRST, _REST = range(3)
_ROWS = "h bigint, g bigint, rec bigint, a int, b int, ref bigint, shift int"


def _sources(first: np.ndarray, size: np.ndarray, r: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows sorted by window, record and place: whether another record has the window too, and that record and its place. The first
    row is the source of the rows of other records, the last one of the first record's."""
    last = first + size - 1
    several = np.repeat(r[first] != r[last], size)
    own = r == np.repeat(r[first], size)
    source = np.where(own, np.repeat(last, size), np.repeat(first, size))
    return several, r[source], p[source]


def _parsed(texts: DataFrame, anchors, least: int, gram: int, seed: int, which: int) -> DataFrame:
    """Rows for the index, and factors that a batch finds by itself.

    Index rows: h, g (two hashes), rec, a (the window's place). Factors: rec, a, b (first and last window), ref, shift (the source, and its place less a).
    The windows looked at are those whose anchor is in the filter `anchors`. _ALL: every one. _FIRST: one in STRIDE, and for each record
    that has any a row with all else null. _REST: the others. But for _ALL, a batch gives one index row a window and one factor a record."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, bits = _Hasher(seed), anchors.value
        for rb in batches:
            rec = rb.column(0).to_numpy(zero_copy_only=False)
            hs, gs, rs, ps, some = [], [], [], [], []
            for start, row, pos, anchor, w in _windows(rb, hasher, least, gram):
                keep = np.flatnonzero(_hit(bits, anchor))
                if len(keep):
                    if which == _FIRST:
                        some.append(np.unique(rec[row[keep]]))
                    x = w.spans(least, start[keep])
                    if which != _ALL:
                        chosen = (x % np.uint64(STRIDE) == 0) == (which == _FIRST)
                        x, keep = x[chosen], keep[chosen]
                    hs.append(x.view(np.int64))
                    gs.append(w.spans(least // 2, start[keep]).view(np.int64))
                    rs.append(rec[row[keep]])
                    ps.append(pos[keep])
            if not hs:
                continue
            h, g, r, p = (np.concatenate(x) for x in (hs, gs, rs, ps))
            o = np.lexsort((p, r, g, h))
            h, g, r, p = h[o], g[o], r[o], p[o]
            first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])]) if len(h) else np.array([], np.int64)
            size = np.diff(np.r_[first, len(h)])
            several, ref, at = _sources(first, size, r, p) if len(h) else (np.array([], bool), r, p)
            if which == _ALL:
                ends = np.zeros(len(h), bool)
                ends[first] = ends[first + size - 1] = True
                ask = np.flatnonzero(~several | ends)
            else:
                ask = first
            k = np.flatnonzero(several)
            fr, fp, fs, fd = r[k], p[k], ref[k], at[k] - p[k]
            if which == _ALL:
                o = np.lexsort((fp, fd, fs, fr))
                fr, fp, fs, fd = fr[o], fp[o], fs[o], fd[o]
                new = np.r_[True, (fr[1:] != fr[:-1]) | (fs[1:] != fs[:-1]) | (fd[1:] != fd[:-1]) | (fp[1:] != fp[:-1] + 1)] if len(fr) else np.array([], bool)
                k = np.flatnonzero(new)
                until = fp[np.r_[k[1:], len(fp)] - 1] if len(fp) else fp
            else:
                _, k = np.unique(fr, return_index=True)
                until = fp[k]
            fr, fp, fs, fd = fr[k], fp[k], fs[k], fd[k]
            any_ = np.unique(np.concatenate(some)) if some else r[:0]
            n, m, z = len(ask), len(fr), len(any_)
            zero = lambda c: np.zeros(c, np.int64)
            col = lambda x, mask, kind: pa.array(x.astype(kind), mask=mask)
            index = np.r_[zero(n), np.ones(m + z, bool)].astype(bool)
            factor = np.r_[np.ones(n, bool), zero(m), np.ones(z, bool)].astype(bool)
            yield pa.RecordBatch.from_arrays(
                [
                    col(np.r_[h[ask], zero(m + z)], index, np.int64),
                    col(np.r_[g[ask], zero(m + z)], index, np.int64),
                    pa.array(np.r_[r[ask], fr, any_]),
                    pa.array(np.r_[p[ask], fp, zero(z)].astype(np.int32)),
                    pa.array(np.r_[p[ask], until, zero(z)].astype(np.int32)),
                    col(np.r_[zero(n), fs, zero(z)], factor, np.int64),
                    col(np.r_[zero(n), fd, zero(z)], factor, np.int32),
                ],
                names=[x.split(" ")[0] for x in _ROWS.split(", ")],
            )

    return texts.mapInArrow(probe, _ROWS)


def _look_up(rows: DataFrame, every: bool) -> DataFrame:
    """rec, a, b, ref, shift of the index rows whose window another record has too; every: for each row, else at least for one of each record. A task holds
    one block of the index, sorted; of a window that runs over several batches only its first row is kept, and those not yet answered."""

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for rb in batches:
            h, g, r, p = (rb.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            if not len(h):
                continue
            told = np.zeros(len(h), bool)
            if kept is not None:
                h, g, r, p, told = (np.concatenate(x) for x in zip(kept, (h, g, r, p, told)))
            first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
            size = np.diff(np.r_[first, len(h)])
            several, ref, at = _sources(first, size, r, p)
            k = np.flatnonzero(several & ~told)
            yield pa.RecordBatch.from_arrays([pa.array(r[k]), pa.array(p[k]), pa.array(p[k]), pa.array(ref[k]), pa.array((at[k] - p[k]).astype(np.int32))], names=["rec", "a", "b", "ref", "shift"])
            done = bool(several[-1])
            tail = slice(first[-1], len(h) if every and not done else first[-1] + 1)
            kept = (h[tail], g[tail], r[tail], p[tail], np.full(len(h[tail]), done))

    return rows.select("h", "g", "rec", "a").repartition("h").sortWithinPartitions("h", "g", "rec", "a").mapInArrow(block, "rec bigint, a int, b int, ref bigint, shift int")


def _checked(factors: DataFrame, texts: DataFrame, least: int) -> DataFrame:
    """factors with `same`: whether the record and its source agree in every character. Where rows of one record differ in text, one of them has to. A record that is the
    source of very many is salted."""
    factors = cut(factors, "factors")
    needed = cut(_only(texts, _filter(factors.select("rec").union(factors.select("ref")).distinct())).distinct(), "needed")
    part = lambda text, at: F.substring(F.col(text), F.col(at) + 1, F.col("b") - F.col("a") + least)
    with_source = salted_join(factors, needed.select(F.col("rec").alias("ref"), F.col("text").alias("source")), "ref").withColumn("at", F.col("a") + F.col("shift")).withColumn("want", part("source", "at"))
    both = with_source.drop("source", "at").join(needed, "rec").withColumn("same", part("text", "a") == F.col("want"))
    return cut(both.groupBy("rec", "a", "b", "ref", "shift").agg(F.max("same").alias("same")), "checked")


def _numbered(records: DataFrame) -> DataFrame:
    return records.select("source_table", F.col("record_id").cast("string").alias("record_id"), F.col("text").cast("string").alias("text")).withColumn("rec", F.xxhash64("source_table", "record_id"))


_FACTOR = ("rec", "a", "b", "ref", "shift")


def _one_factor_each(texts: DataFrame, least: int, gram: int, seed: int) -> DataFrame:
    """A factor of each record that has any."""
    shared = _filter(_shared_anchors(texts, least, gram, seed))

    def found(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        rows = cut(rows, name)
        hit = _look_up(rows.where("h is not null"), False).union(rows.where("ref is not null").select(*_FACTOR))
        one = hit.groupBy("rec").agg(F.min(F.struct("ref", "a", "b", "shift")).alias("x")).select("rec", "x.a", "x.b", "x.ref", "x.shift")
        return cut(one, f"{name}-found"), rows.where("h is null and ref is null").select("rec").distinct()

    sure, some = found(_parsed(texts, shared, least, gram, seed, _FIRST), "first")
    still = _filter(some.join(sure, "rec", "left_anti"))
    open_anchors = _filter(_anchor_rows(texts, least, gram, seed, still, shared).select("anchor").distinct())
    more, _ = found(_parsed(texts, open_anchors, least, gram, seed, _REST), "rest")
    return sure.unionByName(more.join(sure, "rec", "left_anti"))


def _all_factors(texts: DataFrame, least: int, gram: int, seed: int) -> DataFrame:
    """The factors of each record: the longest runs of windows with one source at one distance."""
    rows = cut(_parsed(texts, _filter(_shared_anchors(texts, least, gram, seed)), least, gram, seed, _ALL), "parsed")
    found = _look_up(rows.where("h is not null"), True).union(rows.where("ref is not null").select(*_FACTOR)).distinct()
    w = W.partitionBy("rec", "ref", "shift").orderBy("a", "b")  # places of one record
    reach = F.max("b").over(w.rowsBetween(W.unboundedPreceding, -1))
    runs = found.withColumn("new", F.when(F.col("a") <= reach + 1, 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    return runs.groupBy("rec", "ref", "shift", "run").agg(F.min("a").alias("a"), F.max("b").alias("b")).select(*_FACTOR)


def _verified(records: DataFrame, parse, least: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Factors that agree with their sources in every character, and the numbered records. A parse in which any didn't, because of equal hashes of
    different windows, is made again with other hashes."""
    rows = _numbered(records).where(F.length("text") >= least).where("record_id is not null")
    texts = rows.select("rec", "text")
    for seed in count():
        checked = _checked(parse(texts, least, gram, seed), texts, least)
        if not checked.where("not same").limit(1).count():
            return checked, rows.select("source_table", "record_id", "rec").distinct()


def sharing_records(records: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """source_table, record_id of the records that hold a span of at least `least` code points that stands in another record too.

    records: source_table, record_id, text. Rows with the same table and id are one record, however often they occur: a span
    repeated inside one record alone isn't shared. Null and shorter texts share nothing; null ids are left out."""
    factors, ids = _verified(records, _one_factor_each, least, gram)
    return ids.join(factors.select("rec").distinct(), "rec", "left_semi").select("source_table", "record_id")


def shared_factors(records: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """source_table, record_id, factor_start, factor_end, from_table, from_id, from_start: the factors of each record and where each was found in another. What
    else a passage stands in isn't listed; which of several records is given as the source may differ from run to run."""
    factors, ids = _verified(records, _all_factors, least, gram)
    named = salted_join(factors, ids.select(F.col("rec").alias("ref"), F.col("source_table").alias("from_table"), F.col("record_id").alias("from_id")), "ref").join(ids, "rec")
    return named.select("source_table", "record_id", F.col("a").cast("bigint").alias("factor_start"), (F.col("b") + least).cast("bigint").alias("factor_end"), "from_table", "from_id", (F.col("a") + F.col("shift")).cast("bigint").alias("from_start"))


def shared_spans(records: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """source_table, record_id, span_start, span_end (code points, end exclusive): the longest stretches of each record in which every
    `least` code points in a row stand in another record. Factors that overlap by less have spans of their own. Where rows of one record
    differ in text, the spans are those of all its texts together."""
    factors, ids = _verified(records, _all_factors, least, gram)
    w = W.partitionBy("rec").orderBy("a", "b")  # a record's own factors
    reach = F.max("b").over(w.rowsBetween(W.unboundedPreceding, -1))
    runs = factors.select("rec", "a", "b").distinct().withColumn("new", F.when(F.col("a") <= reach + 1, 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    spans = runs.groupBy("rec", "run").agg(F.min("a").cast("bigint").alias("span_start"), (F.max("b") + least).cast("bigint").alias("span_end"))
    return spans.join(ids, "rec").select("source_table", "record_id", "span_start", "span_end")


def sharing_report(records: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """One row per record: characters, characters in shared spans, each counted once, and their share; empty and null texts have 0 characters and share 0."""
    lengths = _numbered(records).where("record_id is not null").groupBy("source_table", "record_id").agg(F.coalesce(F.max(F.length("text")), F.lit(0)).cast("bigint").alias("chars"))
    w = W.partitionBy("source_table", "record_id").orderBy("span_start", "span_end").rowsBetween(W.unboundedPreceding, -1)
    spans = shared_spans(records, least, gram).withColumn("before", F.coalesce(F.max("span_end").over(w), F.lit(0)))
    covered = spans.groupBy("source_table", "record_id").agg(F.sum(F.greatest(F.lit(0), F.col("span_end") - F.greatest("span_start", "before"))).alias("shared_chars"))
    out = lengths.join(covered, ["source_table", "record_id"], "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0)))
    return out.withColumn("shared", F.when(F.col("chars") > 0, F.least(F.lit(1.0), F.col("shared_chars") / F.col("chars"))).otherwise(0.0))
