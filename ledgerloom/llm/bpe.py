"""Byte-level BPE encoding by a segment tree over the ranks of adjacent pairs.

A text is cut into pieces by the tokenizer's public pattern. In each piece every adjacent pair of symbols has a merge rank; a
segment tree keeps their minimum, ordered by rank and then position, so its root is the leftmost lowest-rank merge. Applying
it changes at most three pairs, each a logarithmic update, until the root says that nothing can be merged: a piece of n bytes takes
O(n log n), however long.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_PATH = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers") + "/byte_bpe_50k.json"
# Fixed value: the pre-tokenizer's public pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_ENTRIES = 200_000
CACHE_CHARS = 40
_NONE = 1 << 62


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: visible Latin-1 characters for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Encoder:
    """Ids of texts without special tokens; strings that look like special tokens are ordinary text. Null and empty texts
    have no ids: an empty list."""

    def __init__(self, path: str = DEFAULT_PATH):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.byte_id = [vocab[c] for c in byte_alphabet()]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.cut = regex.compile(PATTERN).findall
        self.cache: dict[str, list[int]] = {}

    def _piece(self, piece: str) -> list[int]:
        sym = [self.byte_id[b] for b in piece.encode("utf-8")]
        n = len(sym)
        if n < 2:
            return sym
        merges, size = self.merges, 1
        while size < n:
            size *= 2
        # tree[size + i] holds rank * 2^32 + i of the pair that begins at symbol i
        tree = [_NONE] * (2 * size)
        for i in range(n - 1):
            if m := merges.get((sym[i], sym[i + 1])):
                tree[size + i] = m[0] << 32 | i
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            k = size + i
            tree[k] = value
            while k > 1:
                k >>= 1
                a, b = tree[2 * k], tree[2 * k + 1]
                least = a if a < b else b
                if tree[k] == least:
                    break
                tree[k] = least

        while (root := tree[1]) != _NONE:
            i = root & 0xFFFFFFFF
            j = after[i]
            sym[i] = merges[sym[i], sym[j]][1]
            sym[j] = -1
            k = after[i] = after[j]
            put(j, _NONE)
            if k < n:
                before[k] = i
                m = merges.get((sym[i], sym[k]))
                put(i, m[0] << 32 | i if m else _NONE)
            else:
                put(i, _NONE)
            h = before[i]
            if h >= 0:
                m = merges.get((sym[h], sym[i]))
                put(h, m[0] << 32 | h if m else _NONE)
        return [s for s in sym if s >= 0]

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        cache, add = self.cache, out.extend
        for p in self.cut(text):
            ids = cache.get(p)
            if ids is None:
                ids = self._piece(p)
                if len(p) <= CACHE_CHARS:
                    if len(cache) >= CACHE_ENTRIES:
                        cache.clear()
                    cache[p] = ids
            add(ids)
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = DEFAULT_PATH) -> DataFrame:
    """doc_id, ids: one row per row of docs, no shuffle. Null, empty texts give an empty list; a null doc_id stays null.
    Texts that differ by a byte have ids of their own: nothing is normalised."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            flat, ends = array("i"), [0]
            for t in b.column(1).to_pylist():
                flat.extend(enc.encode(t))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), pa.array(np.frombuffer(flat, dtype=np.int32) if len(flat) else np.array([], np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["doc_id", "ids"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def count_tokens(docs: DataFrame, text: str, path: str = DEFAULT_PATH) -> DataFrame:
    """docs with a column `tokens`, the number of ids of its text."""

    @F.pandas_udf("bigint")
    def count(s: pd.Series) -> pd.Series:
        enc = encoder(path)
        return pd.Series([len(enc.encode(t)) for t in s], dtype="int64")

    # not deterministic for the planner only: a filter on tokens must not encode a second time
    return docs.withColumn("tokens", count.asNondeterministic()(F.coalesce(F.col(text).cast("string"), F.lit(""))))
