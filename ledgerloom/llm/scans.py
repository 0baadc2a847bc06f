"""Repair of text from scanned pages.

Two passes over the texts. The first counts words, pairs of neighbouring words, forms that aren't plain words, and parts of broken words. What makes up at least a fixed
share of the corpus is the frequent lexicon: it has at most 1/WORD_SHARE words and 1/PAIR_SHARE pairs whatever the corpus, and is given to every task. All
rarer words with EVIDENCE stay in a table. A symmetric-delete index generates correction candidates: words are indexed under a skeleton in
which characters that a scan takes for each other are the same, and under the skeleton with any one character deleted; the frequent words' index is in memory, the rarer
words' is a join of the distinct forms the frequent lexicon has nothing to say of. A weighted edit distance, cheap for confusion pairs and 1 for any other edit,
ranks the candidates, and neighbouring words decide between equals. The second pass reads the lines: page furniture by recurrence at page edges and by the document's own
title and issuer, broken words by what the corpus says of the joined and of the hyphenated form, misread words by a repair made of
confusions alone.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.skew import salted_join
from ledgerloom.session import cut

WORD_SHARE = 2e-5  # least share of all words: at most 50,000 words
PAIR_SHARE = 2e-6  # least share of all pairs: at most 500,000 pairs
RARER = 50  # a word of the lexicon is itself a misreading if one it can be misread from is so many times as frequent
EVIDENCE = 5  # a word below WORD_SHARE counts as printed from so many occurrences on, and so many for each of the misread form
MOST_GIVEN = 200_000  # so many answers of rarer words are given to every task; more are joined to the records that ask
MOST_KEYS = 400_000  # index keys of rarer words that are broadcast to the forms; more are joined by shuffle
EDGE = 2  # lines from the top or bottom of a page in which furniture is looked for by recurrence

# What a scan reads for what is printed. Skeletons spell out both sides alike.
SKELETON = str.maketrans({"l": "i", "1": "i", "!": "i", "|": "i", "0": "o", "5": "s", "$": "s", "@": "a", "+": "t", "f": "t", "9": "g", "e": "c", "u": "ii", "h": "ii", "b": "ii", "n": "ri", "m": "rri", "w": "vv", "d": "ci"})
# Printed, read.
CONFUSIONS = {
    ("e", "c"), ("c", "e"), ("i", "1"), ("i", "!"), ("i", "l"), ("i", "|"), ("l", "1"), ("l", "|"), ("l", "i"), ("l", "!"), ("o", "0"), ("a", "@"), ("t", "+"), ("t", "f"), ("f", "t"), ("s", "5"), ("s", "$"), ("g", "9"), ("h", "b"), ("b", "h"),
    ("u", "ii"), ("u", "li"), ("m", "rn"), ("rn", "m"), ("w", "vv"), ("vv", "w"), ("ri", "n"), ("n", "ri"), ("li", "h"), ("h", "li"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("n", "rl"), ("n", "r1"), ("d", "c1"), ("h", "1i"), ("h", "l1"), ("m", "nn"), ("m", "rri"), ("m", "ni"), ("nn", "rm"), ("r", "n"),
}
_HYPHENS = "-‐‑¬­"
_SURE_BREAK = "¬­"  # never part of a word
_EDGE_PUNCT = ".,;:()\"'[]{}?‘’“”"
_LETTERS = re.compile(r"^[a-z]+$")
_ROMAN = r"(?:x{0,3}(?:ix|iv|v?i{0,3}))"
_NUMBER = re.compile(rf"^[\[(\-–|.\s]*(?:p[a@]g[ec]\s*[|:.]?\s*)?(?:\d{{1,4}}|{_ROMAN})(?:\s*(?:/|of|0f)\s*\d{{1,4}})?[\])\-–|\s]*$", re.I)
_TRAILING_NUMBER = re.compile(r"\s+(?:p[a@]g[ec]\s*)?\d{1,4}\s*(?:/|of)\s*\d{1,4}\s*$", re.I)
# What imprints begin with.
_IMPRINT = ("registered office", "insurance is the subject matter of solicitation", "uin ")
_RUN = re.compile(r"[A-Za-z0-9@|!+$]{3,}")  # of what a repair looks up in a token
_HEADING = re.compile(r"^\d+(\.\d+)+\s")


def skeleton(word: str) -> str:
    return word.lower().translate(SKELETON)


_IMPRINT_KEYS = tuple(skeleton(x).replace(" ", "") for x in _IMPRINT)
_UIN = re.compile(r"^[u]\S?[il1|!]?\S?n\s+[A-Z0-9]{6,}$", re.I)


def parts(token: str) -> list[str]:
    """The words of a token between white space: outer punctuation dropped, split where it has its own hyphens or slashes."""
    return [p for p in re.split(r"[-‐‑/]", token.strip(_EDGE_PUNCT)) if p]


def weighted_distance(printed: str, read: str) -> float:
    """Edit distance from printed to read; a confusion pair costs 0.2, any other insertion, deletion or substitution 1."""
    n, m = len(printed), len(read)
    d = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if not i and not j:
                continue
            best = float("inf")
            if i and j:
                best = d[i - 1][j - 1] + (printed[i - 1] != read[j - 1])
            if i:
                best = min(best, d[i - 1][j] + 1)
            if j:
                best = min(best, d[i][j - 1] + 1)
            for a in (1, 2):
                for b in (1, 2, 3):
                    if i >= a and j >= b and (printed[i - a : i], read[j - b : j]) in CONFUSIONS:
                        best = min(best, d[i - a][j - b] + 0.2)
            d[i][j] = best
    return d[n][m]


@dataclass
class Lexicon:
    words: dict[str, int]
    pairs: dict[tuple[str, str], int]
    compounds: dict[str, int]
    index: dict[str, list[str]] = field(default_factory=dict)
    known: set[str] = field(default_factory=set)
    prefixes: set[str] = field(default_factory=set)

    def prepare(self) -> "Lexicon":
        by_key = defaultdict(list)
        for w in self.words:
            s = skeleton(w)
            for k in {s, *(s[:i] + s[i + 1 :] for i in range(len(s)))}:
                by_key[k].append(w)
        self.index = dict(by_key)
        self.known = {w for w, n in self.words.items() if not any(self.words[c] >= RARER * n for c in self._alike(w))}
        self.prefixes = {c.split("-")[0] for c in self.compounds}
        self.memo: dict[str, list[tuple[float, str]]] = {}
        return self

    def _alike(self, w: str) -> list[str]:
        s = skeleton(w)
        return [c for c in self.index.get(s, ()) if c != w and weighted_distance(c, w) < 1]

    def candidates(self, w: str) -> list[tuple[float, str]]:
        """(cost, word) of the known words whose skeleton is at most a deletion away on either side, cheapest first."""
        got = self.memo.get(w)
        if got is None:
            s = skeleton(w)
            near = {c for k in (s, *(s[:i] + s[i + 1 :] for i in range(len(s)))) for c in self.index.get(k, ())}
            got = sorted((weighted_distance(c, w), c) for c in near if c in self.known and abs(len(c) - len(w)) <= 3)
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[w] = got
        return got

    def repair(self, w: str, before: str, after: str) -> str | None:
        """The printed word, if w is unknown and a known word can be misread as it; of several as cheap, the one that goes best with its
        neighbours."""
        if w in self.known:
            return None
        same = [(c, k) for c, k in self.candidates(w) if c < 1]
        if not same:
            return None
        if len(same) == 1:
            return same[0][1]
        fit = lambda k: self.pairs.get((before, k), 0) + self.pairs.get((k, after), 0)
        return min(same, key=lambda x: (x[0] - 0.05 * min(10, fit(x[1]).bit_length()), -self.words[x[1]]))[1]


def _askable(p: str) -> bool:
    """Whether a part of a token can be a misread word."""
    return len(p) >= 4 and p.isascii() and sum(map(str.isalpha, p)) >= 2


def _halves(left: str, right: str) -> tuple[str, str] | None:
    """The parts of a word that a token ending in a hyphen and the next one make, in lower case."""
    m = re.search(r"([^\W\d_]+)$", left[:-1])
    r = re.match(r"[^\s\-‐‑/]*", right.strip(_EDGE_PUNCT))[0]
    return (m[1].lower(), r.lower()) if m and r else None


def _count(texts: DataFrame) -> DataFrame:
    """kind (w word, p pair, c hyphenated compound, f form that is no plain word, b parts of a word broken at a hyphen, n totals), a, b, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        pairs: Counter = Counter()

        def flush() -> pa.RecordBatch:
            plain: Counter = Counter()
            for x, n in words.items():
                plain[x.strip(_EDGE_PUNCT)] += n
            rows = [("n", "w", "", sum(words.values())), ("n", "p", "", sum(pairs.values()))]
            for x in [x for x in plain if "-" in x[1:-1]]:
                ps, n = x.split("-"), plain[x]
                if all(map(_LETTERS.match, ps)):
                    rows.append(("c", x, "", n))
                    for q in ps:
                        plain[q] += n
            rows += [("w", x, "", n) for x, n in plain.items() if _LETTERS.match(x)]
            forms: Counter = Counter()
            for x, n in plain.items():
                if x and not _LETTERS.match(x):
                    for q in parts(x):
                        if _askable(q) and not _LETTERS.match(q):
                            forms[q] += n
            close: Counter = Counter()
            broken: Counter = Counter()
            for (x, y), n in pairs.items():
                close[x.strip(_EDGE_PUNCT), y.strip(_EDGE_PUNCT)] += n
                if x[-1] in _HYPHENS and (halves := _halves(x, y)):
                    broken[halves] += n
                    if _askable(q := "".join(halves)) and not _LETTERS.match(q):
                        forms[q] += n
            rows += [("f", x, "", n) for x, n in forms.items()] + [("b", *x, n) for x, n in broken.items()]
            rows += [("p", x, y, n) for (x, y), n in close.items() if _LETTERS.match(x) and _LETTERS.match(y)]
            words.clear(), pairs.clear()
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2]), pa.array(cols[3], pa.int64())], names=["kind", "a", "b", "n"])

        for rb in batches:
            for t in rb.column(0).to_pylist():
                toks = t.lower().split()
                words.update(toks)
                pairs.update(zip(toks, toks[1:]))
                if len(pairs) > 400_000:
                    yield flush()
        yield flush()

    return texts.mapInArrow(run, "kind string, a string, b string, n bigint").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


def corpus_counts(texts: DataFrame) -> DataFrame:
    """texts: one string column."""
    return cut(_count(texts.where(F.col(texts.columns[0]).isNotNull())), "counts")


def corpus_lexicon(counts: DataFrame) -> Lexicon:
    """Only the frequent part comes to the driver: words and pairs above their fixed shares. Rarer words stay in the table, see _rare."""
    totals = {r["a"]: r["n"] for r in counts.where("kind = 'n'").collect()}
    of = lambda kind, share, total: counts.where((F.col("kind") == kind) & (F.col("n") >= max(2, share * totals.get(total, 0)))).collect()
    return Lexicon({r["a"]: r["n"] for r in of("w", WORD_SHARE, "w")}, {(r["a"], r["b"]): r["n"] for r in of("p", PAIR_SHARE, "p")}, {r["a"]: r["n"] for r in of("c", WORD_SHARE, "w")}).prepare()


def _same_text(a: str, b: str) -> bool:
    if a == b:
        return bool(a)
    n, m = len(a), len(b)
    if min(n, m) < 12 or 2 * min(n, m) < 0.9 * (n + m):
        return False
    # a long enough match has equal pieces at equal or near places
    if a[:4] != b[:4] and a[-4:] != b[-4:] and a[n // 2 : n // 2 + 4] not in b:
        return False
    match = SequenceMatcher(None, a, b, autojunk=False)
    return match.quick_ratio() >= 0.9 and match.ratio() >= 0.9


class Reader:
    """Judges the lines of one text."""

    def __init__(self, lexicon: Lexicon):
        self.lex = lexicon
        self.fine: set[str] = set()  # tokens that are never misread, wherever they stand
        self.rare: dict[str, str] = {}  # what words below the lexicon's share say: form -> printed word; "left right" -> + (one word) or - (its own hyphen)
        self.fragment = False  # whether the token read is a part of a broken word, of which rare words say nothing

    def furniture(self, lines: list[str], paged: bool, titles: list[str], recurring: set[str]) -> list[bool]:
        """titles: skeletons of the document's title and issuer; recurring: skeletons that recur at its pages' edges."""
        full = [i for i, x in enumerate(lines) if x.strip()]
        if len(full) < 2 and not paged:
            return [False] * len(lines)  # nothing is left that it could be furniture of
        rank = {i: min(k, len(full) - 1 - k) for k, i in enumerate(full)}
        out = [False] * len(lines)
        for k, i in enumerate(full):
            raw = lines[i].strip()
            edge = rank[i] < EDGE + 1 if paged else 0 < k < len(full) - 1 or len(full) == 1
            if _NUMBER.match(raw):
                out[i] = edge and bool(re.search(r"[\divxIVX]", raw))
                continue
            if paged and rank[i] > EDGE or len(raw) > 200:
                continue
            s = edge_key(raw)
            if s.startswith(_IMPRINT_KEYS[:2]) and len(raw) < 90 and not raw.endswith(".") or _same_text(s, _IMPRINT_KEYS[1]) or _UIN.match(raw):
                out[i] = True
            elif any(_same_text(s, t) or len(s) >= 24 and t.startswith(s) or len(t) >= 24 and s.startswith(t) for t in titles):
                out[i] = True
            elif paged and rank[i] < EDGE and s in recurring:
                out[i] = True
        return out

    def split_word(self, left: str, right: str | None) -> bool:
        """Whether a line that ends in left and a hyphen ends inside a word that goes on with right, rather than at the word's
        own hyphen. The form the corpus uses more decides; where it has neither, a first part of known compounds keeps its hyphen."""
        lex, left = self.lex, left.lower()
        if right is None or not right:
            return left not in lex.prefixes and left not in lex.known
        right = right.lower()
        joined, own = lex.words.get(left + right, 0), lex.compounds.get(f"{left}-{right}", 0)
        if not joined and not own and (rarer := self.rare.get(f"{left} {right}")):
            return rarer == "+"
        if not joined and not own:
            fixed = [c for cost, c in lex.candidates(left + right) if cost < 1]
            joined = lex.words[fixed[0]] if fixed else 0
        if joined or own:
            return joined > own
        if left in lex.prefixes and right in lex.known:
            return False
        return not (left in lex.known and right in lex.known)

    def lines(self, text: str, paged: bool, titles: list[str], recurring: set[str]) -> tuple[list[tuple[int, str]], dict]:
        """((line, kind)...), and how the text begins and ends: for the page before and after."""
        lines = text.split("\n")
        furn = self.furniture(lines, paged, titles, recurring)
        found = [(i + 1, "furniture") for i, f in enumerate(furn) if f]
        body = [i for i, x in enumerate(lines) if x.strip() and not furn[i]]
        state = {"first": "", "open": 0, "left": "", "mark": ""}
        skip_first = None
        for n, i in enumerate(body):
            toks = lines[i].split()
            nxt = lines[body[n + 1]].split() if n + 1 < len(body) else []
            if n == 0:
                state["first"] = toks[0].strip(_EDGE_PUNCT)
            last = toks[-1]
            left = re.search(r"([^\W\d_]+)$", last[:-1]) if last[-1] in _HYPHENS and len(last) > 1 else None
            joined = None
            if left:
                right = re.match(r"[^\s\-‐‑/]*", nxt[0].strip(_EDGE_PUNCT))[0] if nxt else None
                if last[-1] in _SURE_BREAK or n + 1 < len(body) and self.split_word(left[1], right):
                    found.append((i + 1, "broken_word"))
                    joined = (left[1], right or "")
                elif n + 1 == len(body):
                    state |= {"open": i + 1, "left": left[1], "mark": last[-1]}
            words = toks[1 if skip_first else 0 : -1 if left else None]
            if self._misread(words) or joined and self._half(joined, 0) or skip_first and self._half(skip_first, 1):
                found.append((i + 1, "misread"))
            skip_first = joined
        return found, state

    def _half(self, joined: tuple[str, str], side: int) -> bool:
        """Whether a word broken over two lines was misread in its part on this side."""
        left, right = (x.lower() for x in joined)
        w = left + right
        if not right or w in self.lex.known or not re.search(r"[a-z]", w):
            return False
        fixed = self.lex.repair(w, "", "") or self.rare.get(w)
        if not fixed:
            return False
        same = 0
        while same < min(len(w), len(fixed)) and w[same] == fixed[same]:
            same += 1
        return (same >= len(left)) == bool(side)

    def _misread(self, toks: list[str]) -> bool:
        return any(self._misread_at(toks, k) for k, t in enumerate(toks) if t not in self.fine)

    def _misread_at(self, toks: list[str], k: int) -> bool:
        lex, t, open_case = self.lex, toks[k].lower(), False
        if t.strip(_EDGE_PUNCT) not in lex.known:
            for p in parts(t):
                if p in lex.known or len(p) < 3 or not p.isascii() or sum(map(str.isalpha, p)) < 2 or p.rstrip("!+") in lex.known:
                    continue
                if not any(c < 1 for c, _ in lex.candidates(p)):
                    if p in self.rare:
                        open_case = True
                        if not self.fragment:
                            return True
                        continue
                    if len(p) >= 5 and re.fullmatch(r"[a-z]+[0159@|!+][a-z]+", p):
                        return True
                    continue
                open_case = True
                before = toks[k - 1].lower().strip(_EDGE_PUNCT) if k else ""
                after = toks[k + 1].lower().strip(_EDGE_PUNCT) if k + 1 < len(toks) else ""
                fixed = lex.repair(p, before, after)
                if fixed and (not _LETTERS.match(p) or len(p) >= 4 or lex.pairs.get((before, fixed)) or lex.pairs.get((fixed, after))):
                    return True
        if not open_case:
            if len(self.fine) > 500_000:
                self.fine.clear()
            self.fine.add(toks[k])
        return False

    def _fixed_token(self, toks: list[str], k: int) -> str:
        """The token with its misread parts put right; the case of its first letter is kept."""
        t = toks[k]
        return t if t in self.fine or not self._misread_at(toks, k) else self._put_right(toks, k)

    def _put_right(self, toks: list[str], k: int) -> str:
        around = [x.lower().strip(_EDGE_PUNCT) for x in (toks[k - 1] if k else "", toks[k + 1] if k + 1 < len(toks) else "")]

        def put(m: re.Match) -> str:
            fixed = self.lex.repair(m[0].lower(), *around) or (None if self.fragment else self.rare.get(m[0].lower()))
            return m[0] if not fixed else fixed.upper() if m[0].isupper() and len(m[0]) > 1 else fixed.capitalize() if m[0][0].isupper() else fixed

        return _RUN.sub(put, toks[k])

    def asks(self, text: str, furn: list[bool]) -> set[str]:
        """All keys of `rare` that lines and repaired can look up in a text, whatever is answered."""
        lines = text.split("\n")
        out = {p for t in {*text.split()} for p in (*parts(t.lower()), *(x.lower() for x in _RUN.findall(t))) if _askable(p)}
        body = [toks for x, f in zip(lines, furn) if not f and (toks := x.split())]
        for toks, nxt in zip(body, body[1:]):
            if toks[-1][-1] not in _HYPHENS:
                continue
            right = re.match(r"[^\s\-‐‑/]*", nxt[0].strip(_EDGE_PUNCT))[0]
            self.fragment = True
            for last in (toks[-1], self._put_right(toks, len(toks) - 1)):
                if left := re.search(r"([^\W\d_]+)$", last[:-1]):
                    out |= {f"{left[1]} {right}".lower(), f"{left[1]}{right}".lower(), f"{left[1].lower()} {right.lower()}", left[1].lower() + right.lower()}
            self.fragment = False
        return out

    def repaired(self, text: str, paged: bool, titles: list[str], recurring: set[str]) -> str:
        """Paragraphs, separated by an empty line each: furniture dropped, broken words joined, misread words put right."""
        lines = text.split("\n")
        furn = self.furniture(lines, paged, titles, recurring)
        out: list[str] = []
        gap, glue = True, ""
        full = [i for i, x in enumerate(lines) if not furn[i]]
        for n, i in enumerate(full):
            toks = lines[i].split()
            if not toks:
                # an empty line beside furniture is the page's, not the paragraph's
                beside = (i and furn[i - 1]) or (i + 1 < len(lines) and furn[i + 1])
                gap = gap or not (beside and out and out[-1][-1:] not in ".:;!?")
                continue
            ends, whole = {0} if out and not glue else set(), toks
            if toks[-1][-1] in _HYPHENS:
                ends.add(len(toks) - 1)
            toks = []
            for k in range(len(whole)):
                self.fragment = k in ends
                toks.append(self._fixed_token(whole, k))
            self.fragment = False
            heading = bool(_HEADING.match(lines[i].strip())) and len(toks) < 8
            nxt = next((lines[j].split() for j in full[n + 1 :] if lines[j].strip()), [])
            last, ending = toks[-1], " "
            left = re.search(r"([^\W\d_]+)$", last[:-1]) if last[-1] in _HYPHENS and len(last) > 1 else None
            if left and nxt:
                right = re.match(r"[^\s\-‐‑/]*", nxt[0].strip(_EDGE_PUNCT))[0]
                if last[-1] in _SURE_BREAK or self.split_word(left[1], right):
                    toks[-1] = last[:-1]
                ending = ""
            line = " ".join(toks)
            if gap or heading or not out:
                out.append(line)
            else:
                out[-1] += glue + line
            gap, glue = heading, ending
        return "\n\n".join(out)


def edge_key(line: str) -> str:
    """Skeleton of a line without a page number at its end and without spaces."""
    return re.sub(r"\s+", "", skeleton(_TRAILING_NUMBER.sub("", line.strip())))


def _edges(pages: DataFrame) -> DataFrame:
    """document_id, recurring: skeletons of lines that stand at the edge of at least two pages of a document, that aren't headings or ends of
    sentences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            out = []
            for doc, page, text in zip(*(rb.column(i).to_pylist() for i in range(3))):
                full = [x.strip() for x in text.split("\n") if x.strip()]
                for x in {*full[:EDGE], *full[-EDGE:]}:
                    if len(x) >= 12 and not x.endswith((".", ",", ";")) and not _HEADING.match(x) and (x[0].isupper() or not x[0].isalpha()):
                        out.append((doc, page, edge_key(x)))
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], names=["document_id", "page_number", "key"])

    rows = pages.select("document_id", "page_number", "text").mapInArrow(run, "document_id string, page_number int, key string")
    twice = rows.groupBy("document_id", "key").agg(F.min("page_number").alias("a"), F.max("page_number").alias("b")).where("a < b")
    return twice.groupBy("document_id").agg(F.collect_set("key").alias("recurring"))


def _unknown(lex: Lexicon, p: str) -> bool:
    """Whether the frequent lexicon has nothing to say of a part of a token, so that rarer words have to be asked."""
    return _askable(p) and p not in lex.known and p.rstrip("!+") not in lex.known and not any(c < 1 for c, _ in lex.candidates(p))


def _rarer(counts: DataFrame, lexicon) -> DataFrame:
    """key, answer: what words below the lexicon's share say. A misread form has the printed word; the parts "left right" of a broken word have + if the
    corpus has them as one word more often than with a hyphen, else -. All words with EVIDENCE are looked up, by joins on their skeletons and
    deletions over the distinct forms; none of this comes to the driver."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            at, out = [], []
            for i, w in enumerate(rb.column(0).to_pylist()):
                if not _unknown(lexicon.value, w):
                    continue
                k = skeleton(w)
                ks = {k, *(k[:j] + k[j + 1 :] for j in range(len(k)))}
                at += [i] * len(ks)
                out += ks
            kept = rb.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(out, pa.string())], names=["w", "n", "key"])

    @F.pandas_udf("double")
    def cost(word: pd.Series, form: pd.Series) -> pd.Series:
        return pd.Series([weighted_distance(a, b) for a, b in zip(word, form)], dtype="float64")

    index = "w string, n bigint, key string"
    words = counts.where("kind = 'w'").select(F.col("a").alias("w"), "n")
    halves = counts.where("kind = 'b'").select(F.col("a").alias("left"), F.col("b").alias("right"))
    joined = halves.select(F.concat("left", "right").alias("w"), F.lit(0).cast("bigint").alias("n"))
    forms = words.unionByName(counts.where("kind = 'f'").select(F.col("a").alias("w"), "n")).unionByName(joined.where(F.col("w").rlike("^[a-z]+$"))).where("length(w) >= 4")
    forms = forms.groupBy("w").agg(F.sum("n").alias("n"))
    word_keys = cut(words.where(f"n >= {EVIDENCE} and length(w) >= 4").mapInArrow(keys, index).withColumnsRenamed({"w": "word", "n": "m"}), "word-keys")
    form_keys = forms.mapInArrow(keys, index).withColumnRenamed("w", "form")
    near = form_keys.join(F.broadcast(word_keys) if word_keys.count() <= MOST_KEYS else word_keys, "key")
    near = near.where(f"word <> form and m >= {EVIDENCE} * n and abs(length(word) - length(form)) <= 3").select("form", "word", "m").distinct()
    fixes = near.withColumn("cost", cost("word", "form")).where("cost < 1").groupBy("form").agg(F.min(F.struct("cost", (-F.col("m")).alias("less"), "word")).alias("x")).select(F.col("form").alias("key"), F.col("x.word").alias("answer"))
    own = counts.where("kind = 'c'").select(F.col("a").alias("compound"), F.col("n").alias("own"))
    said = halves.withColumn("w", F.concat("left", "right")).withColumn("compound", F.concat_ws("-", "left", "right"))
    said = said.join(words.withColumnRenamed("n", "one"), "w", "left").join(own, "compound", "left").where(f"greatest(coalesce(one, 0), coalesce(own, 0)) >= {EVIDENCE}")
    splits = said.select(F.concat_ws(" ", "left", "right").alias("key"), F.when(F.coalesce("one", F.lit(0)) > F.coalesce("own", F.lit(0)), "+").otherwise("-").alias("answer"))
    return cut(fixes.unionByName(splits), "rarer")


def _asked(rows: DataFrame, lexicon, answers: DataFrame) -> DataFrame:
    """source_table, record_id, rare: the answers to all that each record can ask, where they are too many to be given to every task. rows: of _prepared, without rare."""

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lexicon.value)
        for rb in batches:
            out = set()
            for src, rec, text, title, issuer, recurring in zip(*(rb.column(i).to_pylist() for i in range(6))):
                furn = reader.furniture(text.split("\n"), src == "page_read", _titles(title, issuer), set(recurring or ()))
                out.update((src, rec, k) for k in reader.asks(text, furn))
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["source_table", "record_id", "key"])

    asks = rows.select("source_table", "record_id", "text", "title", "issuer", "recurring").mapInArrow(forms, "source_table string, record_id string, key string")
    return cut(salted_join(asks, answers, "key").groupBy("source_table", "record_id").agg(F.map_from_entries(F.collect_set(F.struct("key", "answer"))).alias("rare")), "asked")


def _titles(title: str | None, issuer: str | None) -> list[str]:
    return [edge_key(x) for x in (title, issuer) if x and x.strip()]


_JUDGED = "source_table string, record_id string, document_id string, page_number int, first string, open int, left string, mark string, line_no array<bigint>, kind array<string>"


def _judge(rows: DataFrame, lexicon, given) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lexicon.value)
        for rb in batches:
            out = []
            for src, rec, doc, page, text, title, issuer, recurring, rare in zip(*(rb.column(i).to_pylist() for i in range(9))):
                reader.rare = given.value if given is not None else dict(rare or ())
                found, st = reader.lines(text, src == "page_read", _titles(title, issuer), set(recurring or ()))
                out.append((src, rec, doc, page, st["first"], st["open"], st["left"], st["mark"], [a for a, _ in found], [b for _, b in found]))
            cols = list(zip(*out)) or [()] * 10
            kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split(" ")[0] for x in _JUDGED.split(", ")])

    return rows.select("source_table", "record_id", "document_id", "page_number", "text", "title", "issuer", "recurring", "rare").mapInArrow(run, _JUDGED)


def _prepared(pages: DataFrame, clauses: DataFrame, documents: DataFrame):
    """Records with text and their documents' titles, the frequent lexicon, and the answers of rarer words: broadcast, or, where they are many, with the records and as a
    table. What a record is told is the same either way. Repeated rows are one record."""
    page = pages.where("text is not null and record_id is not null").select(F.lit("page_read").alias("source_table"), "record_id", "document_id", "page_number", "text")
    clause = clauses.where("text is not null and record_id is not null").select(F.lit("policy_clause").alias("source_table"), "record_id", "document_id", F.lit(None).cast("int").alias("page_number"), "text")
    counts = corpus_counts(page.select("text").unionByName(clause.select("text")))
    lexicon = page.sparkSession.sparkContext.broadcast(corpus_lexicon(counts))
    info = documents.where("corpus_document_id is not null").groupBy(F.col("corpus_document_id").alias("document_id")).agg(F.min("title").alias("title"), F.min("issuer").alias("issuer"))
    info = cut(info.join(_edges(page), "document_id", "full"), "info")
    lined = page.unionByName(clause.where("contains(text, '\n')")).where("document_id is not null")
    blank = page.where("document_id is null").unionByName(clause.where("not contains(text, '\n') or document_id is null"))
    none = lambda df: df.select("*", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("issuer"), F.lit(None).cast("array<string>").alias("recurring"))
    # a record of an unknown document still has to be read
    missing = lined.join(info.select("document_id"), "document_id", "left_anti")
    lines = salted_join(lined, info, "document_id").unionByName(none(missing)).unionByName(none(blank))
    answers = _rarer(counts, lexicon)
    if answers.count() <= MOST_GIVEN:
        given = page.sparkSession.sparkContext.broadcast({r["key"]: r["answer"] for r in answers.collect()})
        return lines.withColumn("rare", F.lit(None).cast("map<string,string>")), lexicon, given
    return lines.join(_asked(lines, lexicon, answers), ["source_table", "record_id"], "left"), lexicon, answers


def _one_word(rows: DataFrame, right, lexicon, given) -> DataFrame:
    """rows with one: whether `left`, the last part of a page, and right, the first of the next, are one word, without a hyphen of its own. given: the answers of rarer
    words, broadcast or as a table."""
    first = lambda b: re.match(r"[^\s\-/]*", b)[0] if isinstance(b, str) else None
    many = isinstance(given, DataFrame)
    held = None if many else given

    @F.pandas_udf("string")
    def key(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([f"{a.lower()} {first(b).lower()}" if isinstance(b, str) else None for a, b in zip(left, right)], dtype=object)

    @F.pandas_udf("boolean")
    def goes_on(left: pd.Series, right: pd.Series, answer: pd.Series) -> pd.Series:
        reader, out = Reader(lexicon.value), []
        for a, b, said in zip(left, right, answer):
            b = first(b)
            reader.rare = held.value if held is not None else {f"{a.lower()} {b.lower()}": said} if isinstance(said, str) else {}
            out.append(reader.split_word(a, b))
        return pd.Series(out, dtype=bool)

    if not many:
        return rows.withColumn("one", goes_on("left", right, F.lit(None).cast("string")))
    asking = rows.withColumn("_right", right).withColumn("_key", key("left", "_right"))
    told = asking.join(given.withColumnsRenamed({"key": "_key", "answer": "_answer"}), "_key", "left")
    return told.withColumn("one", goes_on("left", "_right", "_answer")).drop("_key", "_right", "_answer")


def line_faults(pages: DataFrame, clauses: DataFrame, documents: DataFrame) -> DataFrame:
    """source_table, record_id, line_no, kind: furniture, broken_word and misread lines.

    pages: record_id, document_id, page_number, text; clauses: record_id, document_id, text; documents:
    corpus_document_id, title, issuer. Null and empty texts have no such lines; repeated rows count once; a record whose document is
    unknown is judged without title and issuer. Lines are split at the line feed and counted from 1."""
    rows, lexicon, given = _prepared(pages, clauses, documents)
    held = None if isinstance(given, DataFrame) else given
    judged = cut(_judge(rows, lexicon, held), "judged")
    inside = judged.select("source_table", "record_id", F.explode(F.arrays_zip("line_no", "kind")).alias("x")).select("source_table", "record_id", "x.line_no", "x.kind")
    # the last body line of a page may go on on the next page
    firsts = judged.where("source_table = 'page_read' and first <> ''").groupBy("document_id", (F.col("page_number") - 1).alias("page_number")).agg(F.min("first").alias("right"))
    open_ = judged.where("open > 0").select("source_table", "record_id", "document_id", "page_number", "open", "left", "mark")
    ends = open_.join(firsts, ["document_id", "page_number"], "left")

    over = _one_word(ends, F.col("right"), lexicon, given).where("one").select("source_table", "record_id", F.col("open").cast("bigint").alias("line_no"), F.lit("broken_word").alias("kind"))
    return inside.unionByName(over).distinct()


def repaired_texts(pages: DataFrame, clauses: DataFrame, documents: DataFrame) -> DataFrame:
    """source_table, record_id, repaired: the text of each record as continuous paragraphs; inputs as for line_faults. A word broken at the end of a page stands
    whole at that page's end, and the next page begins behind it; where a page was read more than once, the first in order of text counts for its neighbours. A
    record without text has no row; where rows of one record differ in text, each has one."""
    rows, lexicon, given = _prepared(pages, clauses, documents)
    held = None if isinstance(given, DataFrame) else given

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lexicon.value)
        for rb in batches:
            out = []
            for src, rec, doc, page, text, title, issuer, recurring, rare in zip(*(rb.column(i).to_pylist() for i in range(9))):
                reader.rare = held.value if held is not None else dict(rare or ())
                out.append((src, rec, doc, page, reader.repaired(text, src == "page_read", _titles(title, issuer), set(recurring or ()))))
            cols = list(zip(*out)) or [()] * 5
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["source_table", "record_id", "document_id", "page_number", "repaired"])

    schema = "source_table string, record_id string, document_id string, page_number int, repaired string"
    done = cut(rows.select("source_table", "record_id", "document_id", "page_number", "text", "title", "issuer", "recurring", "rare").mapInArrow(run, schema).distinct(), "repaired")
    of_pages = done.where("source_table = 'page_read' and document_id is not null and page_number is not null")
    left = F.regexp_extract("repaired", rf"(?<![^\s])\S*?([\p{{L}}\p{{M}}]+)[{_HYPHENS}]$", 1)
    begin = F.regexp_extract("repaired", r"^(\p{L}\S*)", 1)
    tails = of_pages.select("document_id", "page_number", left.alias("left")).where("left <> ''").groupBy("document_id", "page_number").agg(F.min("left").alias("left"))
    heads = of_pages.select("document_id", (F.col("page_number") - 1).alias("page_number"), begin.alias("begin")).where("begin <> ''").groupBy("document_id", "page_number").agg(F.min("begin").alias("begin"))
    over = _one_word(tails.join(heads, ["document_id", "page_number"]), F.regexp_extract("begin", r"^([\p{L}\p{M}]+)", 1), lexicon, given)
    over = cut(over, "over")
    out = done.join(over.select("document_id", "page_number", "left", "begin", "one"), ["document_id", "page_number"], "left")
    out = out.join(over.select("document_id", (F.col("page_number") + 1).alias("page_number"), F.col("begin").alias("taken")), ["document_id", "page_number"], "left")
    page, text = F.col("source_table") == "page_read", F.col("repaired")
    whole = F.when(page & F.col("left").isNotNull() & (left == F.col("left")), F.concat(F.when(F.col("one"), F.left(text, F.length(text) - 1)).otherwise(text), "begin")).otherwise(text)
    whole = F.when(page & F.col("taken").isNotNull() & (begin == F.col("taken")), F.ltrim(F.regexp_replace(F.substring(whole, F.length("taken") + 1, F.length(whole)), r"^\s+", ""))).otherwise(whole)
    return out.select("source_table", "record_id", whole.alias("repaired")).distinct()
