"""Near-duplicate records: BagMinHash signatures, bands, and exact verification of the overlap."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.bagminhash import bands, mix, signatures
from ledgerloom.operators.components import components
from ledgerloom.operators.skew import salted_join
from ledgerloom.session import cut, discard

#: Bytes of lower-case words, all others as spaces; of UTF-8, so letters beyond ASCII are no part of a word.
_OF_WORDS = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))
EXPAND = 64  # copies: classes up to this size are expanded into all pairs, larger ones are given as pairs with their representative
BLOCK = 512  # members of a group are paired in blocks of about so many
BATCH_ITEMS = 25_000
CROWD = 1_000  # buckets of more classes aren't paired within; their classes take the exact way
COUNTERS = 1 << 16  # in which a task counts its own buckets
PARTS = 3  # in which the bands are shuffled and paired, one after the other, so that one part at a time is on disk twice
HOT_IN_TASK = 4 * CROWD  # a bucket whose counter is fuller in one task is crowded; its further classes don't leave for the bucket at all


@dataclass(frozen=True)
class Likeness:
    """Bags of `run` words in a row, alike from `threshold` on; found by `bands` bands of `rows` registers. multiset: repeated runs
    count as often as they occur, else once. The chance to miss a pair of similarity s is (1 - s^rows)^bands."""

    run: int
    threshold: float
    rows: int
    bands: int
    multiset: bool = False


#: 0.70: missed with 0.25 % at the threshold, 0.04 % at 0.75.
CLAUSE_TEXT = Likeness(run=3, threshold=0.70, rows=6, bands=48)
#: 0.75: missed with 0.2 % at the threshold, under 0.001 % at 0.80. Titles share many words, hence the longer bands.
TITLE = Likeness(run=1, threshold=0.75, rows=8, bands=60)
#: The default for word shingles.
SHINGLES = Likeness(run=5, threshold=0.80, rows=8, bands=40)
#: Words as often as they occur, in runs of five.
WEIGHTED = Likeness(run=5, threshold=0.80, rows=6, bands=36, multiset=True)


class _Hashed(dict):
    """Hashes of words, each made once per worker."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class _Bags:
    """Texts to bags of hashed runs of words."""

    def __init__(self, like: Likeness):
        self.like = like
        self.words = _Hashed()

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """bag, run hash, count; sorted by bag and hash. At most 65,536 texts at a time."""
        if len(self.words) > 1_000_000:
            self.words.clear()
        hashed, sizes, known = array("Q"), [], self.words.__getitem__
        for t in texts:
            ws = t.lower().encode().translate(_OF_WORDS).split() if t else ()
            sizes.append(len(ws))
            hashed.extend(map(known, ws))
        h, n = np.frombuffer(hashed, dtype=np.uint64), np.array(sizes, dtype=np.int64)
        bag, k = np.repeat(np.arange(len(n)), n), self.like.run
        if len(h) < k:
            return np.array([], np.int64), np.array([], np.uint64), np.array([], np.int64)
        with np.errstate(over="ignore"):
            acc = h[: len(h) - k + 1] + np.uint64(k)
            for i in range(1, k):
                acc = mix(acc) + h[i : len(h) - k + 1 + i]
            acc = mix(acc)
        inside = bag[: len(h) - k + 1] == bag[k - 1 :]
        b, acc = bag[: len(h) - k + 1][inside], acc[inside]
        order = np.argsort(acc)
        order = order[np.argsort(b[order].astype(np.uint16), kind="stable")]
        b, acc = b[order], acc[order]
        if not len(b):
            return b, acc, b
        first = np.flatnonzero(np.r_[True, (b[1:] != b[:-1]) | (acc[1:] != acc[:-1])])
        count = np.diff(np.r_[first, len(b)])
        return b[first], acc[first], count if self.like.multiset else np.ones(len(first), np.int64)


def _bag_keys(bag: np.ndarray, run: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit key of each bag's content and its total weight; 0 and 0 for an empty bag."""
    key, total = np.zeros(n, np.uint64), np.bincount(bag, weights=count, minlength=n).astype(np.int64)
    with np.errstate(over="ignore"):
        np.add.at(key, bag, mix(run + count.astype(np.uint64)))
        key = mix(key + total.astype(np.uint64))
    return key.view(np.int64), total


_SIGNED = "field string, id string, text_hash bigint, cls bigint, full array<bigint>, " + ", ".join(f"bands{k} array<bigint>" for k in range(PARTS))


def _signed(docs: DataFrame, likes: dict[str, Likeness]) -> DataFrame:
    """field, id, text_hash, cls, full, bands0, bands1, ...: the class of equal bags of each record that has any run, and, once in each task that meets the class,
    its buckets, dealt to PARTS columns; full has those that are crowded in this task already."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        counts = np.zeros(COUNTERS, np.int64)
        bags_of = {f: _Bags(like) for f, like in likes.items()}
        for whole in batches:
            for field in pc.unique(whole.column(0)).to_pylist():
                of_field = whole.filter(pc.equal(whole.column(0), field))
                like, salt = likes[field], np.uint64(xxhash.xxh3_64_intdigest(field))
                for start in range(0, of_field.num_rows, 2_000):
                    rb = of_field.slice(start, 2_000)
                    n = rb.num_rows
                    bag, run, count = bags_of[field].of(rb.column(3).to_pylist())
                    with np.errstate(over="ignore"):
                        run = mix(run + salt)
                    key, total = _bag_keys(bag, run, count, n)
                    new = np.zeros(n, bool)
                    for i in np.flatnonzero(total):
                        k = int(key[i])
                        if k not in seen:
                            seen.add(k)
                            new[i] = True
                    number = np.cumsum(new) - 1
                    keep = new[bag] if len(bag) else np.array([], bool)
                    bag, run, count = number[bag[keep]], run[keep], count[keep]
                    bags = int(new.sum())
                    ends = np.searchsorted(bag, np.arange(bags + 1))
                    hs, a = np.zeros((bags, like.bands), np.int64), 0
                    while a < bags:  # as many bags at a time as have BATCH_ITEMS runs
                        b = max(a + 1, int(np.searchsorted(ends, ends[a] + BATCH_ITEMS, side="right")) - 1)
                        s = slice(ends[a], ends[b])
                        hs[a:b] = bands(signatures(bag[s] - a, run[s], count[s], b - a, like.rows * like.bands), like.rows, int(salt >> np.uint64(40)))
                        a = b
                    at = hs.ravel() % COUNTERS
                    counts += np.bincount(at, minlength=COUNTERS)
                    hot = (counts[at] > HOT_IN_TASK).reshape(hs.shape)
                    some = total > 0
                    first = new[some]

                    def lists(mask: np.ndarray, part: slice) -> pa.ListArray:
                        each, mask = np.zeros(len(first), np.int64), mask[:, part]  # noqa: B023
                        each[first] = mask.sum(axis=1)  # noqa: B023
                        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(each)].astype(np.int32)), pa.array(hs[:, part][mask]))  # noqa: B023

                    kept = pa.array(some)
                    parts = [lists(~hot, slice(k, None, PARTS)) for k in range(PARTS)]
                    yield pa.RecordBatch.from_arrays([*(rb.column(i).filter(kept) for i in range(3)), pa.array(key[some]), lists(hot, slice(None)), *parts], names=[x.split(" ")[0] for x in _SIGNED.split(", ")])

    return docs.where("id is not null").select("field", "id", "text_hash", "text").mapInArrow(sign, _SIGNED)


def _meet(rows: DataFrame) -> DataFrame:
    """a, b: the pairs of classes that share a bucket of at most CROWD; a alone: the classes of a crowded one. rows: band, cls; a null cls says that the
    bucket is crowded. A task reads its buckets one after the other and holds at most CROWD classes of the one that goes on. They are sorted by band alone,
    which Spark does by radix; the classes of the few buckets that have several are put in order here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.array([], np.int64)
        last, held, full = none, none, False  # the bucket the last batch ended in, its classes, and whether it is crowded and they are given already

        def out(a: np.ndarray, b: np.ndarray | None = None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b) if b is not None else pa.nulls(len(a), pa.int64())], names=["a", "b"])

        def pairs_of(band: np.ndarray, cls: np.ndarray) -> Iterator[pa.RecordBatch]:
            d = 1
            while len(k := np.flatnonzero(band[d:] == band[:-d])) if d < len(band) else False:
                yield out(cls[k], cls[k + d])
                d += 1

        for rb in batches:
            if not rb.num_rows:
                continue
            null = np.r_[np.zeros(len(held), bool), np.asarray(rb.column(1).is_null())]
            band = np.r_[np.repeat(last, len(held)), rb.column(0).to_numpy(zero_copy_only=False)]
            cls = np.r_[held, rb.column(1).fill_null(0).to_numpy(zero_copy_only=False)]
            marked = np.union1d(band[null], last) if full else np.unique(band[null])
            last = band[-1:]
            first = np.flatnonzero(np.r_[True, band[1:] != band[:-1]])
            size = np.diff(np.r_[first, len(band)])
            many = (size > min(1, CROWD)) | np.isin(band[first], marked)
            many[-1] = True
            many = np.repeat(many, size) & ~null
            band, cls = band[many], cls[many]
            order = np.lexsort((cls, band))
            band, cls = band[order], cls[order]
            new = np.r_[True, (band[1:] != band[:-1]) | (cls[1:] != cls[:-1])][: len(band)]
            band, cls = band[new], cls[new]
            first = np.flatnonzero(np.r_[True, band[1:] != band[:-1]][: len(band)])
            size = np.diff(np.r_[first, len(band)])
            crowded = np.repeat((size > CROWD) | np.isin(band[first], marked), size)
            if crowded.any():
                yield out(cls[crowded])
            ends = band == last
            held, full = cls[ends & ~crowded], bool((ends & crowded).any() or np.isin(last, marked).any())
            yield from pairs_of(band[~crowded & ~ends], cls[~crowded & ~ends])
        yield from pairs_of(np.repeat(last, len(held)), held)

    return rows.repartition("band").sortWithinPartitions("band").mapInArrow(run, "a bigint, b bigint")


def _one_text(docs: DataFrame, members: DataFrame, classes: DataFrame) -> DataFrame:
    """field, cls, text: one text of each of the classes."""
    one = members.join(classes, "cls", "left_semi").groupBy("cls").agg(F.min(F.struct("field", "id", "text_hash")).alias("x")).select("cls", "x.*")
    return docs.join(one, ["field", "id", "text_hash"]).select("field", "cls", "text").dropDuplicates(["cls"])


def _in_blocks(rows: DataFrame, key: str, item: str, carry: list[str]) -> DataFrame:
    """Pairs of the rows of each key, x_ and y_ of item and carry, with x_item < y_item. The rows of a key are dealt to blocks of about BLOCK and
    pairs of blocks are joined, so no task pairs a whole large group."""
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    dealt = cut(salted_join(rows, sizes.select(key, "blocks"), key).withColumn("block", F.pmod(F.xxhash64(item), F.col("blocks")).cast("int")), "dealt", free=True)
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    named = lambda p: [F.col(c).alias(f"{p}_{c}") for c in (item, *carry)]
    left = dealt.select(key, *named("x"), F.col("block").alias("i"), F.explode(F.filter(other, lambda k: k >= F.col("block"))).alias("j"))
    right = dealt.select(key, *named("y"), F.col("block").alias("j"), F.explode(F.filter(other, lambda k: k <= F.col("block"))).alias("i"))
    both = left.join(right, [key, "i", "j"]).where(f"i < j or x_{item} < y_{item}").where(f"x_{item} <> y_{item}")
    turn = F.col(f"x_{item}") > F.col(f"y_{item}")
    return both.select(*[F.when(turn, F.col(f"y_{c}")).otherwise(F.col(f"x_{c}")).alias(f"x_{c}") for c in (item, *carry)], *[F.when(turn, F.col(f"x_{c}")).otherwise(F.col(f"y_{c}")).alias(f"y_{c}") for c in (item, *carry)])


def _exact_candidates(classes: DataFrame, members: DataFrame, docs: DataFrame, likes: dict[str, Likeness]) -> DataFrame:
    """a, b: all pairs of the given classes that can be alike, by the prefix filter: two bags of that overlap share one of their rarest
    runs. Nothing is missed, and full buckets don't matter here."""
    texts = _one_text(docs, members, classes)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags_of = {f: _Bags(like) for f, like in likes.items()}
        for rb in batches:
            for field in pc.unique(rb.column(0)).to_pylist():
                part = rb.filter(pc.equal(rb.column(0), field))
                like, salt = likes[field], np.uint64(xxhash.xxh3_64_intdigest(field))
                cls = part.column(1).to_numpy(zero_copy_only=False)
                bag, run, count = bags_of[field].of(part.column(2).to_pylist())
                size = np.bincount(bag, weights=count, minlength=len(cls)).astype(np.int64)
                with np.errstate(over="ignore"):
                    run = mix(run + salt)
                n = len(run)
                yield pa.RecordBatch.from_arrays([pa.array(cls[bag]), pa.array(run.view(np.int64)), pa.array(count), pa.array(size[bag]), pa.array(np.full(n, like.threshold))], names=["cls", "run", "count", "size", "least"])

    runs = cut(texts.mapInArrow(explode, "cls bigint, run bigint, count bigint, size bigint, least double"), "runs", free=True)
    df = runs.groupBy("run").agg(F.count(F.lit(1)).alias("df"))
    w = W.partitionBy("cls").orderBy("df", "run").rowsBetween(W.unboundedPreceding, -1)  # the runs of one text
    before = F.coalesce(F.sum("count").over(w), F.lit(0))
    prefix = salted_join(runs, df, "run").withColumn("before", before).where("before <= size - ceil(size * (least - 1e-9))").select("cls", "run", "size", "least")
    pairs = _in_blocks(cut(prefix, "prefix", free=True), "run", "cls", ["size", "least"])
    near = "x_size >= y_size * x_least - 1e-6 and y_size >= x_size * x_least - 1e-6"
    return pairs.where(near).select(F.col("x_cls").alias("a"), F.col("y_cls").alias("b")).distinct()


def _class_pairs(docs: DataFrame, likes: dict[str, Likeness], exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(field, a, b, similarity) of the pairs of different classes, a < b, that are alike; and (field, id, cls) of the records. docs: field, id, text."""
    docs = docs.select("field", F.col("id").cast("string").alias("id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    signed = cut(_signed(docs, likes), "signed", free=True)
    members, read = cut(signed.groupBy("field", "id", "cls").agg(F.min("text_hash").alias("text_hash")), "members", free=True), [signed]
    if exact:
        candidates = _exact_candidates(members.select("cls").distinct(), members, docs, likes)
    else:
        marks = signed.where("size(full) > 0").select(F.explode("full").alias("band")).distinct().select("band", F.lit(None).cast("bigint").alias("cls"))
        for k in range(PARTS):
            rows = signed.where(f"size(bands{k}) > 0").select(F.explode(f"bands{k}").alias("band"), "cls")
            read.append(cut(_meet(rows.unionByName(marks)), "met", free=True))
        met = reduce(DataFrame.union, read[1:])
        candidates = met.where("b is not null")
        packed = met.where("b is null").select(F.col("a").alias("cls")).union(signed.where("size(full) > 0").select("cls"))
        if packed.limit(1).count():
            read.append(cut(packed.distinct(), "packed", free=True))
            candidates = candidates.union(_exact_candidates(read[-1], members, docs, likes))
    candidates = cut(candidates.distinct(), "candidates", free=True)
    discard(*read)
    # one text of each class that has a candidate
    texts = cut(_one_text(docs, members, candidates.select(F.col("a").alias("cls")).union(candidates.select("b")).distinct()), "texts", free=True)
    pairs = candidates.join(texts.select("field", F.col("cls").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("cls").alias("b"), F.col("text").alias("tb")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags_of = {f: _Bags(like) for f, like in likes.items()}
        for rb in batches:
            for field in pc.unique(rb.column(0)).to_pylist():
                part, like = rb.filter(pc.equal(rb.column(0), field)), likes[field]
                for at in range(0, part.num_rows, 10_000):
                    p = part.slice(at, 10_000)
                    n = p.num_rows
                    where: dict[str, int] = {}
                    number = [where.setdefault(t, len(where)) for t in p.column(3).to_pylist() + p.column(4).to_pylist()]
                    bag, run, count = bags_of[field].of(list(where))
                    ends = np.searchsorted(bag, np.arange(len(where) + 1))
                    whole = np.bincount(bag, weights=count, minlength=len(where))
                    sim, sizes = np.zeros(n), whole[np.array(number)].reshape(2, n)
                    for i in np.flatnonzero(sizes.min(axis=0) >= sizes.max(axis=0) * (like.threshold - 1e-9)):  # else the sizes alone tell that they aren't alike
                        x, y = number[i], number[n + i]
                        s, t = slice(ends[x], ends[x + 1]), slice(ends[y], ends[y + 1])
                        at_y = np.searchsorted(run[t], run[s])
                        at_y[at_y == t.stop - t.start] = 0
                        hit = run[t][at_y] == run[s]
                        both = np.minimum(count[s][hit], count[t][at_y[hit]]).sum()
                        sim[i] = both / (whole[x] + whole[y] - both)
                    ok = pa.array(sim >= like.threshold - 1e-12)
                    yield pa.RecordBatch.from_arrays([p.column(0).filter(ok), p.column(1).filter(ok), p.column(2).filter(ok), pa.array(sim).filter(ok)], names=["field", "a", "b", "similarity"])

    alike = pairs.select("field", "a", "b", "ta", "tb").mapInArrow(verify, "field string, a bigint, b bigint, similarity double")
    alike = cut(alike, "alike", free=True)
    discard(candidates, texts)
    return alike, members.select("field", "id", "cls")


def _single(docs: DataFrame, like: Likeness) -> tuple[DataFrame, dict[str, Likeness]]:
    return docs.select(F.lit("").alias("field"), "id", "text"), {"": like}


def class_pairs(docs: DataFrame, like: Likeness, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(a, b, similarity) of the pairs of different classes, a < b, that are alike; and (id, cls) of the records.

    docs: id, text. Null ids are left out; null texts and texts without a run of words have no class. Repeated rows count
    once. Similarity is exact: the overlap of every candidate's bags is counted from the whole texts. exact: candidates come from the prefix filter
    alone, which misses none."""
    alike, members = _class_pairs(*_single(docs, like), exact)
    return alike.drop("field"), members.drop("field")


def all_field_pairs(docs: DataFrame, likes: dict[str, Likeness], exact: bool = False) -> DataFrame:
    """field, id_a, id_b of all alike records of each field, id_a < id_b, whatever the size of their classes: as many rows as there are pairs.

    docs: field, id, text. The members of a class are dealt to blocks of about BLOCK, and pairs of blocks are joined, so no task pairs whole large classes."""
    alike, members = _class_pairs(docs, likes, exact)
    sizes = cut(members.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("only"), F.min("field").alias("field")), "sizes", free=True)
    side = lambda p: sizes.select(F.col("cls").alias(p), F.col("n").alias(f"n{p}"), F.col("only").alias(f"i{p}"))
    across = cut(alike.select("field", "a", "b").join(side("a"), "a").join(side("b"), "b"), "across", free=True)
    single = across.where("na = 1 and nb = 1").select("field", "ia", "ib")
    dealt = cut(salted_join(members, sizes.where("n > 1").select("cls", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "cls").select("cls", "id", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")), "dealt", free=True)
    # one member of a single class is a block of its own
    large = across.where("na > 1 or nb > 1")
    ends = large.where("na = 1").select(F.col("a").alias("cls"), F.col("ia").alias("id")).union(large.where("nb = 1").select("b", "ib")).distinct()
    dealt = dealt.unionByName(ends.withColumn("block", F.lit(0)))
    pieces = lambda n: F.explode(F.sequence(F.lit(0), (F.ceil(F.col(n) / BLOCK) - 1).cast("int")))
    each = large.select("field", "a", "b", "na", "nb").unionByName(sizes.where("n > 1").select("field", F.col("cls").alias("a"), F.col("cls").alias("b"), F.col("n").alias("na"), F.col("n").alias("nb")))
    each = each.withColumn("ka", pieces("na")).withColumn("kb", pieces("nb")).where("a <> b or ka <= kb").select("field", "a", "b", "ka", "kb")
    left = each.join(dealt.select(F.col("cls").alias("a"), F.col("block").alias("ka"), F.col("id").alias("ia")), ["a", "ka"])
    both = left.join(dealt.select(F.col("cls").alias("b"), F.col("block").alias("kb"), F.col("id").alias("ib")), ["b", "kb"]).where("ia <> ib").where("a <> b or ka <> kb or ia < ib")
    return single.unionByName(both.select("field", "ia", "ib")).select("field", F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")).distinct()


def all_pairs(docs: DataFrame, like: Likeness, exact: bool = False) -> DataFrame:
    """id_a, id_b: all_field_pairs of one field."""
    return all_field_pairs(*_single(docs, like), exact).drop("field")


def pairs(docs: DataFrame, like: Likeness) -> DataFrame:
    """id_a, id_b of alike records, id_a < id_b, in a short form; all_pairs has all of them.

    Records of equal bags are alike too. Up to EXPAND of them are paired with each other and with all records like them;
    a larger class is given in the short form: each record with the class's representative, its smallest id, and the representative
    with the records like it, from which all pairs follow."""
    alike, members = class_pairs(docs, like)
    sizes = members.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("rep"))
    sized = cut(salted_join(members, sizes, "cls"), "sized")
    acting = sized.where(f"n <= {EXPAND} or id = rep").select("cls", "id", "rep", "n")
    left, right = acting.select(F.col("cls").alias("a"), F.col("id").alias("ia")), acting.select(F.col("cls").alias("b"), F.col("id").alias("ib"))
    across = alike.join(left, "a").join(right, "b").select("ia", "ib")
    few = sized.where(f"n > 1 and n <= {EXPAND}")
    within = few.select("cls", F.col("id").alias("ia")).join(few.select("cls", F.col("id").alias("ib")), "cls").where("ia < ib").select("ia", "ib")
    star = sized.where(f"n > {EXPAND} and id <> rep").select(F.col("rep").alias("ia"), F.col("id").alias("ib"))
    both = across.unionByName(within).unionByName(star)
    return both.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")).distinct()


def field_groups(docs: DataFrame, likes: dict[str, Likeness]) -> DataFrame:
    """field, id, group_id, links: every record that has a run of words, the smallest id of the group it belongs to by chains of alike
    records, and the number of other classes its text is alike to. docs: field, id, text."""
    alike, members = _class_pairs(docs, likes)
    comp = components(alike).withColumnRenamed("node", "cls")
    links = alike.select(F.col("a").alias("cls")).union(alike.select("b")).groupBy("cls").agg(F.count(F.lit(1)).alias("links"))
    classes = members.groupBy("cls").agg(F.min("id").alias("first")).join(comp, "cls", "left").join(links, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    named = classes.groupBy("component").agg(F.min("first").alias("group_id"))
    of_class = classes.join(named, "component").select("cls", "group_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
    return salted_join(members, of_class, "cls").select("field", "id", "group_id", "links")


def groups(docs: DataFrame, like: Likeness) -> DataFrame:
    """id, group_id, links: field_groups of one field."""
    return field_groups(*_single(docs, like)).drop("field")
