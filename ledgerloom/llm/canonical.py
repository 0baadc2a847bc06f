"""One consistent form for text that looks the same.

Only unstable segments are touched: runs of characters that fail a quick check (combining marks, composable or
compatibility forms, look-alike letters, odd spaces, invisible characters), taken together with the stable character before
them, with which they may combine. Each segment is normalised alone and spliced into the unchanged rest. What is
stable alone is stable in context, since every character that could combine with its left neighbour fails the quick check.

Which letters look alike comes from the Unicode confusables data, as the ICU library of the Spark session has them: letters of scripts drawn like Latin, Latin ones included, whose
skeleton is that of one ASCII letter. A few more are stated here.

Case, digits, punctuation and accents stay. Compatibility forms that look different from their plain ones
(superscripts, fractions, circled and squared forms) stay too.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.skew import salted_join

# Letters of other scripts drawn like Latin ones, and hyphens drawn like the ASCII one. They go before the confusables data.
LOOK_ALIKE = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ү": "Y", "Ӏ": "I", "Ԁ": "D",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ү": "y", "ӏ": "l", "ԍ": "g", "ԑ": "e",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "ι": "i", "ρ": "p", "υ": "u",
    # Armenian
    "օ": "o", "Օ": "O", "հ": "h", "ո": "n", "ս": "u", "զ": "q", "ց": "g", "Տ": "S", "Լ": "L",
    # Latin letters of their own with the shape of others
    "ɡ": "g", "ɑ": "a", "ı": "i", "ꓲ": "I", "ⅼ": "l", "ꞵ": "ß",
    # hyphens
    "‐": "-", "‑": "-", "﹣": "-", "－": "-",
}
# Compatibility tags whose plain form looks the same.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>")


def _invisible(c: str) -> bool:
    """Format characters, variation selectors, fillers: they take no room of their own."""
    o = ord(c)
    return unicodedata.category(c) == "Cf" and not 0x600 <= o <= 0x605 and o not in (0x6DD, 0x70F, 0x8E2, 0x110BD, 0x110CD) or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or o in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x3164, 0xFFA0)


#: Scripts whose letters are drawn like Latin ones, by the first words of their letters' names.
_SCRIPTS = ("LATIN", "GREEK", "CYRILLIC", "ARMENIAN", "COPTIC", "CHEROKEE", "LISU")


def look_alikes(spark: SparkSession) -> dict[str, str]:
    """Letters that look like an ASCII letter, and that letter: of those with its skeleton one of the same case; of a script without case, the capital."""
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    letters = [c for c in map(chr, range(0x80, 0x20000)) if unicodedata.category(c)[0] == "L" and unicodedata.name(c, "").startswith(_SCRIPTS) and not unicodedata.decomposition(c)]
    latin = [chr(o) for o in (*range(65, 91), *range(97, 123))]
    skeletons = checker.getSkeleton("\n".join(latin + letters)).split("\n")
    of: dict[str, list[str]] = {}
    for x, k in zip(latin, skeletons):
        of.setdefault(k, []).append(x)
    out = {}
    for c, k in zip(letters, skeletons[len(latin) :]):
        same = [x for x in of.get(k, ()) if unicodedata.category(x) == ("Ll" if unicodedata.category(c) == "Ll" else "Lu")]
        if same:
            out[c] = same[0]
    return out | LOOK_ALIKE


class Canon:
    """The canonical form under a table of look-alikes."""

    def __init__(self, table: dict[str, str]):
        self.table = table
        self.known: dict[str, str] = {}
        self._pattern: re.Pattern | None = None

    def plain(self, c: str) -> str:
        """The characters a single one stands for, decomposed."""
        got = self.known.get(c)
        if got is None:
            got = self.known[c] = self._plain(c)
        return got

    def _plain(self, c: str) -> str:
        if _invisible(c):
            return ""
        if c in self.table:
            return self.table[c]
        if unicodedata.category(c) == "Zs":
            return " "
        d = unicodedata.decomposition(c)
        if not d:
            return c
        tag, *codes = d.split() if d[0] == "<" else ("", *d.split())
        if tag and tag not in SAME_LOOK:
            return c
        if tag == "<compat>" and unicodedata.category(c) in ("Mn", "Sk", "Lm", "No", "So"):
            return c
        return "".join(self.plain(chr(int(x, 16))) for x in codes)

    def segment(self, s: str) -> str:
        return unicodedata.normalize("NFC", "".join(map(self.plain, unicodedata.normalize("NFD", s))))

    def unstable(self) -> re.Pattern:
        """The quick check as a pattern: a stable character, if any, and the unstable run after it. Hangul syllables are left out
        by rule: they are stable and there are 11,172 of them."""
        if self._pattern is None:
            bad = []
            for o in range(0x80, 0x20000):
                if 0xAC00 <= o <= 0xD7A3 or 0xD800 <= o <= 0xDFFF:
                    continue
                c = chr(o)
                if unicodedata.combining(c) or 0x1161 <= o <= 0x11FF or self.segment(c) != c or unicodedata.normalize("NFC", "a" + c) != "a" + c or unicodedata.category(c) == "Mc":
                    bad.append(o)
            bad += range(0xE0000, 0xE01F0)
            runs, start = [], bad[0]
            for a, b in zip(bad, [*bad[1:], -1]):
                if b != a + 1:
                    runs.append(f"{re.escape(chr(start))}-{re.escape(chr(a))}" if a > start else re.escape(chr(a)))
                    start = b
            cls = "".join(runs)
            self._pattern = re.compile(f"[^{cls}]?[{cls}]+")
        return self._pattern

    def form(self, text: str | None) -> str | None:
        """Null stays null, empty stays empty; ASCII text is returned as it is. All ASCII is stable, so only the other runs, each with the character
        before it, are checked closely."""
        if text is None or text.isascii():
            return text
        fix, out, last = self.unstable().sub, [], 0
        for m in _NOT_ASCII.finditer(text):
            a = max(last, m.start() - 1)
            segment = text[a : m.end()]
            new = fix(lambda x: self.segment(x[0]), segment)
            if new != segment:
                out += (text[last:a], new)
                last = m.end()
        return "".join(out) + text[last:] if out else text


_NOT_ASCII = re.compile(r"[^\x00-\x7f]+")


@lru_cache(maxsize=4)
def canon_of(table: tuple[tuple[str, str], ...]) -> Canon:
    """One per Python worker and table."""
    return Canon(dict(table))


def canonical(text: str | None) -> str | None:
    """The form under the stated look-alikes alone."""
    return canon_of(tuple(LOOK_ALIKE.items())).form(text)


def canonical_column(c: Column, table: dict[str, str]) -> Column:
    """c under a table of look-alikes. Equal texts of a batch are normalised once."""
    items = tuple(sorted(table.items()))

    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        codes, values = pd.factorize(s)
        form = canon_of(items).form
        done = [form(v) for v in values]
        return pd.Series([done[k] if k >= 0 else None for k in codes], dtype=object)

    return fold(c)


def canonical_texts(rows: DataFrame, text: str) -> DataFrame:
    """rows with text in its one form, as column `canonical`; other columns as they are. ASCII texts never leave the JVM."""
    table = look_alikes(rows.sparkSession)
    odd = F.col(text).rlike(r"[^\x00-\x7F]")
    plain = rows.where(F.coalesce(~odd, F.lit(True))).withColumn("canonical", F.col(text))
    return plain.unionByName(rows.where(odd).withColumn("canonical", canonical_column(F.col(text), table)))


def quotes_only_alike(citations: DataFrame, clauses: DataFrame) -> DataFrame:
    """citation_id, clause_id: quotes that stand in the cited clause only after both texts have their one form.

    citations: citation_id, ref_id, quote; clauses: clause_id, original_text. Keys are compared without case and
    outer white space. Null or empty quotes, null texts and unknown keys give no row; repeated rows give one. A key that holds a
    large share of the citations is salted."""
    key = lambda c: F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    cites = citations.where("quote <> ''").select("citation_id", key(F.col("ref_id")).alias("key"), "quote")
    texts = clauses.where("original_text is not null").select(key(F.col("clause_id")).alias("key"), "clause_id", "original_text")
    pairs = salted_join(cites, texts, "key").where("not contains(original_text, quote)").where((F.col("quote").rlike(r"[^\x00-\x7F]")) | F.col("original_text").rlike(r"[^\x00-\x7F]"))
    table = look_alikes(citations.sparkSession)
    both = pairs.select("citation_id", "clause_id", canonical_column(F.col("quote"), table).alias("q"), canonical_column(F.col("original_text"), table).alias("t"))
    return both.where("q <> '' and contains(t, q)").select("citation_id", "clause_id").distinct()
