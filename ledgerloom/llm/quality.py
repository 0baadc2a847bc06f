"""Text quality statistics of documents, judged against the documents of the same language.

Each statistic has a KLL quantile sketch per language: sketches of any parts of a corpus merge into that of the whole, and their
size doesn't grow with it. From the sketches come a document's percentiles and its robust z-scores: the distance from the language's median in units of the spread
between the median and the upper quartile, as the lower quartile may already lie in the junk. A document far out in a tail of one statistic, or in the tails of several,
isn't prose.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.session import cut

#: White space is what str.split takes for it: tab to carriage return, the separators U+001C to U+001F, U+0085 and the category Z.
_BREAK = regex.compile("\r\n|[\n\x0b\f\r\x85  ]")
_ODD_BREAK = regex.compile("[\x0b\f\r\x85  ]")
_ENDS, _CLOSERS = ".!?…।॥", "\"'”’)]"
_LETTER, _DEVANAGARI, _PLAIN = regex.compile(r"[\p{L}\p{M}]"), regex.compile(r"\p{Devanagari}"), regex.compile(r"[\p{L}\p{M}\p{N}]")
_OUTER = regex.compile(r"^[^\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+$")
_CODE = regex.compile(r"^\s*([A-Za-z]+)")
#: A word is common in a language if it stands in so great a share of its documents.
COMMON_SHARE = 0.2
#: A language with fewer documents has no common words and no scores: its documents count as prose.
LEAST_DOCS = 20
#: So many common words of all languages are given to every task; if there are more, they are joined.
MOST_GIVEN = 200_000
STATISTICS = ("words", "mean_word_length", "symbol_share", "line_end_share", "common_share")
#: Robust z-scores beyond which a document lies in a tail, below and above; in SEVERAL tails it isn't prose.
TAILS = {"words": (-0.55, None), "mean_word_length": (-4.0, 4.0), "symbol_share": (None, 4.5), "line_end_share": (-0.6, None), "common_share": (-3.0, None)}
SEVERAL = 3
#: And those beyond which one is enough.
FAR = {"mean_word_length": (-6.0, 20.0), "symbol_share": (None, 8.0), "common_share": (-4.0, None)}
#: Spreads are at least so wide: a language whose documents are nearly all alike has no tails for trifles.
LEAST_SPREAD = {"words": 1.0, "mean_word_length": 0.05, "symbol_share": 0.002, "line_end_share": 0.02, "common_share": 0.01}
SKETCH_K = 800


def language_of(lang: str | None, text: str) -> str:
    """The declared language without region; text that is mostly Devanagari is hi, and text that isn't can't be hi. Null, empty and
    und are en where the script allows it."""
    if not text.isascii():
        deva = len(_DEVANAGARI.findall(text))
        if deva and 2 * deva > len(_LETTER.findall(text)):
            return "hi"
    m = _CODE.match(lang or "")
    code = m[1].lower() if m else ""
    return "en" if code in ("", "und", "hi") else code


class _Tokens:
    """Of a token: the plain word (lower case, without what isn't a letter, mark or digit at either end) and its number of symbols."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[str, int]] = {}

    def __call__(self, token: str) -> tuple[str, int]:
        got = self.known.get(token)
        if got is None:
            if len(self.known) > 300_000:
                self.known.clear()
            got = (_OUTER.sub("", token.lower()), len(token) - len(_PLAIN.findall(token)))
            if len(token) <= 60:
                self.known[token] = got
        return got


def line_ends(text: str) -> tuple[int, int]:
    """Lines that aren't blank, and those of them that end in a mark of a sentence's end, closing quotes and brackets aside."""
    lines = _BREAK.split(text) if _ODD_BREAK.search(text) else text.split("\n")
    full = [x for x in map(str.strip, lines) if x]
    return len(full), sum(x.rstrip(_CLOSERS)[-1:] in _ENDS and x.rstrip(_CLOSERS) != "" for x in full)


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, text of each row; a null text is an empty one."""
    return docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def common_words(docs: DataFrame) -> DataFrame:
    """language, word: the words that stand in at least COMMON_SHARE of a language's documents with text, counted over all of them. A batch of documents
    gives one row a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = _Tokens()
        for rb in batches:
            df: dict[str, Counter] = {}
            for lang, text in zip(rb.column(1).to_pylist(), rb.column(2).to_pylist()):
                words = {token(t)[0] for t in set(text.split())}
                if words:
                    words.discard("")
                    of = df.setdefault(language_of(lang, text), Counter())
                    of.update(words)
                    of[""] += 1  # documents
            rows = [(a, w, n) for a, c in df.items() for w, n in c.items()]
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64()))], names=["language", "word", "n"])

    df = cut(_texts(docs).mapInArrow(run, "language string, word string, n bigint").groupBy("language", "word").agg(F.sum("n").alias("n")), "df")
    docs_of = df.where("word = ''").select("language", F.col("n").alias("docs")).where(f"docs >= {LEAST_DOCS}")
    return cut(df.where("word <> ''").join(docs_of, "language").where(F.col("n") >= COMMON_SHARE * F.col("docs")).select("language", "word"), "common")


_OUT = "doc_id bigint, language string, words bigint, mean_word_length double, symbol_share double, line_end_share double, common_share double"


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, language and the STATISTICS of each document.

    words: runs between white space; mean_word_length: characters (code points) of a word; symbol_share: share of the characters other than
    white space that are no letters, marks or digits; line_end_share: share of the lines that aren't blank which end in . ! ? … or
    a danda, quotes and brackets after it aside; common_share: share of words that are common in the language. Null, empty and blank texts have 0 words and null in all else; common_share is null too where the language has fewer
    than LEAST_DOCS documents. Repeated rows of a doc_id give one row each."""
    common = common_words(docs)
    given = None
    if common.count() <= MOST_GIVEN:
        given = {}
        for r in common.collect():
            given.setdefault(r["language"], set()).add(r["word"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = _Tokens()
        for rb in batches:
            out = []
            for doc, lang, text in zip(*(rb.column(i).to_pylist() for i in range(3))):
                tokens = text.split()
                language, n = language_of(lang, text), len(tokens)
                if not n:
                    out.append((doc, language, 0, None, None, None, None, []))
                    continue
                plain: Counter = Counter()
                symbols = 0
                for t, k in Counter(tokens).items():
                    word, odd = token(t)
                    plain[word] += k
                    symbols += k * odd
                chars = sum(map(len, tokens))
                lines, ended = line_ends(text)
                own = given.get(language) if given is not None else None
                hits = sum(k for w, k in plain.items() if w in own) / n if own is not None else None
                out.append((doc, language, n, chars / n, symbols / chars, ended / lines, hits, [] if given is not None else list(plain.items())))
            cols = list(zip(*out)) or [()] * 8
            kinds = [pa.int64(), pa.string(), pa.int64(), *[pa.float64()] * 4, pa.list_(pa.struct([("word", pa.string()), ("k", pa.int64())]))]
            cols[7] = [[{"word": w, "k": k} for w, k in x] for x in cols[7]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split(" ")[0] for x in _OUT.split(", ")] + ["plain"])

    rows = cut(_texts(docs).mapInArrow(run, _OUT + ", plain array<struct<word:string,k:bigint>>").withColumn("row", F.monotonically_increasing_id()), "statistics")
    if given is not None:
        return rows.drop("plain", "row")
    hits = rows.select("row", "language", F.inline("plain")).join(common, ["language", "word"]).groupBy("row").agg(F.sum("k").alias("hits"))
    known = common.select("language").distinct().withColumn("known", F.lit(True))
    share = F.when(F.col("known") & (F.col("words") > 0), F.coalesce("hits", F.lit(0)) / F.col("words"))
    return rows.join(hits, "row", "left").join(known, "language", "left").withColumn("common_share", share).select(*[x.split(" ")[0] for x in _OUT.split(", ")])


def _up_to(x: Column):
    return lambda v: v <= x


def _beyond(bounds: dict[str, tuple[float | None, float | None]]) -> Column:
    """The statistics whose score lies beyond its bounds."""
    out = []
    for s, (low, high) in bounds.items():
        z, of = F.col(f"{s}_z"), F.lit(False)
        of = of | (z < low) if low is not None else of
        of = of | (z > high) if high is not None else of
        out.append(F.when(of, s))
    return F.array_compact(F.array(*out))


def scored(stats: DataFrame) -> DataFrame:
    """stats with <statistic>_z and <statistic>_pct, by the sketches of each language, `tails` (the statistics in a tail), `far` (those far out) and
    `prose`. Documents without words have null scores and prose false; those of a language with fewer than LEAST_DOCS documents have null scores and
    prose true. The spread is that above the median, or below it where there is none above, and at least LEAST_SPREAD."""
    sketches = stats.where("words > 0").groupBy("language").agg(F.count(F.lit(1)).alias("docs"), *[F.kll_sketch_agg_double(F.col(s).cast("double"), SKETCH_K).alias(f"{s}_k") for s in STATISTICS])
    cuts = F.array(*[F.lit(q / 100) for q in range(101)])
    marks = cut(sketches.where(f"docs >= {LEAST_DOCS}").select("language", *[F.kll_sketch_get_quantile_double(f"{s}_k", cuts).alias(f"{s}_q") for s in STATISTICS]), "marks")
    out = stats.join(marks, "language", "left")
    for s in STATISTICS:
        x, q = F.col(s).cast("double"), F.col(f"{s}_q")
        off, above, below = x - q[50], q[75] - q[50], q[50] - q[25]
        spread = F.greatest(F.when(above > 0, above).otherwise(below) / 0.6745, F.lit(LEAST_SPREAD[s]))
        out = out.withColumn(f"{s}_z", F.when(q.isNotNull() & x.isNotNull() & (F.col("words") > 0), off / spread))
        out = out.withColumn(f"{s}_pct", F.when(q.isNotNull() & (F.col("words") > 0), F.greatest(F.lit(0), F.size(F.filter(q, _up_to(x))) - 1).cast("double")))
    out = out.drop(*[f"{s}_q" for s in STATISTICS]).withColumn("tails", _beyond(TAILS)).withColumn("far", _beyond(FAR))
    return out.withColumn("prose", (F.col("words") > 0) & (F.size("far") == 0) & (F.size("tails") < SEVERAL))
