"""SQL that says the same as the queries of this subpackage, where SQL can."""

from __future__ import annotations

from ledgerloom.llm.canonical import LOOK_ALIKE
from ledgerloom.llm.neardup import CLAUSE_TEXT, TITLE
from ledgerloom.llm.spans import LEAST


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ------------------------------------------------------------ p3
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_ASCII = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
_SPACES = "\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "  　"
_SINGLE = {k: v for k, v in LOOK_ALIKE.items() if len(v) == 1 and k not in _WIDE}
_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}


def _one_form(c: str) -> str:
    c = f"translate({c}, {_quote(_WIDE + _SPACES + ''.join(_SINGLE))}, {_quote(_ASCII + ' ' * len(_SPACES) + ''.join(_SINGLE.values()))})"
    for k, v in _LIGATURES.items():
        c = f"replace({c}, '{k}', '{v}')"
    return f"nfc_normalize(regexp_replace({c}, '[\\x{{ad}}\\x{{200b}}-\\x{{200f}}\\x{{202a}}-\\x{{202e}}\\x{{2060}}-\\x{{2064}}\\x{{feff}}]', '', 'g'))"


_P3 = f"""WITH q AS (SELECT DISTINCT citation_id, lower(trim(ref_id)) AS k, quote FROM citation WHERE ref_type = 'policy_clause' AND quote <> ''),
 t AS (SELECT DISTINCT clause_id, lower(trim(clause_id)) AS k, original_text FROM policy_clause WHERE original_text IS NOT NULL),
 j AS (SELECT citation_id, clause_id, {_one_form('quote')} AS a, {_one_form('original_text')} AS b FROM q JOIN t USING (k) WHERE NOT contains(original_text, quote))
 SELECT DISTINCT citation_id, clause_id FROM j WHERE a <> '' AND contains(b, a)"""


# ------------------------------------------------------------ p4
def _alike(field: str, table: str, key: str, text: str, run: int, threshold: float) -> str:
    n = field
    shingle = " || ' ' || ".join(f"w[i + {k}]" for k in range(run))
    return f"""
 {n}_w AS (SELECT {key} AS id, regexp_extract_all(lower({text}), '[a-z0-9]+') AS w FROM (SELECT DISTINCT {key}, {text} FROM {table} WHERE {key} IS NOT NULL)),
 {n}_s AS (SELECT DISTINCT id, {shingle} AS s FROM {n}_w, unnest(range(1, len(w) - {run - 2})) AS u(i)),
 {n}_n AS (SELECT id, count(*) AS n FROM {n}_s GROUP BY 1),
 {n}_p AS (SELECT x.id AS id_a, y.id AS id_b, count(*) AS common FROM {n}_s x JOIN {n}_s y ON x.s = y.s AND x.id < y.id GROUP BY 1, 2),
 {n}_f AS (SELECT id_a, id_b FROM {n}_p JOIN {n}_n a ON a.id = id_a JOIN {n}_n b ON b.id = id_b WHERE common >= {threshold} * (a.n + b.n - common) - 1e-9)"""


_P4 = (
    "WITH "
    + ",".join((_alike("c", "policy_clause", "clause_id", "original_text", CLAUSE_TEXT.run, CLAUSE_TEXT.threshold), _alike("t", "corpus_document", "corpus_document_id", "title", TITLE.run, TITLE.threshold)))
    + " SELECT 'clause_text' AS field, id_a, id_b FROM c_f UNION ALL SELECT 'title', id_a, id_b FROM t_f"
)

_P4_MULTISET = """WITH w AS (SELECT clause_id AS id, regexp_extract_all(lower(original_text), '[a-z0-9]+') AS w FROM (SELECT DISTINCT clause_id, original_text FROM policy_clause WHERE clause_id IS NOT NULL)),
 s AS (SELECT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS s, count(*) AS k FROM w, unnest(range(1, len(w) - 3)) AS u(i) GROUP BY 1, 2),
 n AS (SELECT id, sum(k) AS n FROM s GROUP BY 1), p AS (SELECT x.id AS id_a, y.id AS id_b, sum(least(x.k, y.k)) AS common FROM s x JOIN s y ON x.s = y.s AND x.id < y.id GROUP BY 1, 2)
 SELECT id_a, id_b FROM p JOIN n a ON a.id = id_a JOIN n b ON b.id = id_b WHERE common >= 0.8 * (a.n + b.n - common) - 1e-9"""

# ------------------------------------------------------------ p6
_RECORDS = """r AS (SELECT DISTINCT 'policy_clause' AS source_table, clause_id AS record_id, original_text AS t FROM policy_clause UNION ALL SELECT DISTINCT 'citation', citation_id::VARCHAR, quote FROM citation UNION ALL SELECT DISTINCT 'rule_outcome', outcome_id::VARCHAR, quote FROM rule_outcome)"""
_SHARED = f"""{_RECORDS},
 w AS (SELECT source_table, record_id, i - 1 AS pos, md5_number(substr(t, i::BIGINT, {LEAST})) AS h FROM r, unnest(range(1, length(t) - {LEAST - 2})) AS u(i) WHERE length(t) >= {LEAST}),
 g AS (SELECT h FROM w GROUP BY h HAVING min(source_table || '/' || record_id) <> max(source_table || '/' || record_id)),
 s AS (SELECT DISTINCT source_table, record_id, pos FROM w SEMI JOIN g USING (h)),
 k AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY source_table, record_id ORDER BY pos) <= 1 THEN 0 ELSE 1 END AS new FROM s),
 f AS (SELECT *, sum(new) OVER (PARTITION BY source_table, record_id ORDER BY pos) AS run FROM k),
 spans AS (SELECT source_table, record_id, min(pos) AS span_start, max(pos) + {LEAST} AS span_end FROM f GROUP BY source_table, record_id, run)"""

# ------------------------------------------------------------ p10
_WS = r"[\t-\r \x{1c}-\x{1f}\x{85}\p{Z}]+"
_STATS = rf"""
 a AS (SELECT doc_id, coalesce(text, '') AS text, lower(regexp_extract(coalesce(lang, ''), '^\s*([A-Za-z]+)', 1)) AS code FROM documents),
 b AS (SELECT doc_id, text, CASE WHEN 2 * length(regexp_replace(text, '[^\p{{Devanagari}}]', '', 'g')) > length(regexp_replace(text, '[^\p{{L}}\p{{M}}]', '', 'g')) THEN 'hi' WHEN code IN ('', 'und', 'hi') THEN 'en' ELSE code END AS language,
   list_transform(string_split_regex(lower(regexp_replace(text, '^{_WS}|{_WS}$', '', 'g')), '{_WS}'), lambda x: regexp_replace(x, '^[^\p{{L}}\p{{M}}\p{{N}}]+|[^\p{{L}}\p{{M}}\p{{N}}]+$', '', 'g')) AS plain,
   regexp_replace(text, '{_WS}', '', 'g') AS solid,
   list_filter(list_transform(string_split_regex(text, '\r\n|[\n\x{{0b}}\f\r\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: regexp_replace(x, '^{_WS}|{_WS}$', '', 'g')), lambda x: x <> '') AS lines FROM a),
 d AS (SELECT language, count(*) AS docs FROM b WHERE solid <> '' GROUP BY 1 HAVING count(*) >= 20),
 common AS (SELECT language, list(word) AS ws FROM (SELECT language, word, count(*) AS df FROM (SELECT DISTINCT doc_id, language, unnest(plain) AS word FROM b WHERE solid <> '') WHERE word <> '' GROUP BY 1, 2) JOIN d USING (language) WHERE df >= 0.2 * docs GROUP BY 1),
 st AS (SELECT doc_id, language, CASE WHEN solid <> '' THEN len(plain) ELSE 0 END AS words, CASE WHEN solid <> '' THEN length(solid) / len(plain) END AS mean_word_length,
   CASE WHEN solid <> '' THEN length(regexp_replace(solid, '[\p{{L}}\p{{M}}\p{{N}}]', '', 'g')) / length(solid) END AS symbol_share,
   CASE WHEN solid <> '' THEN len(list_filter(lines, lambda x: regexp_matches(x, '[.!?…।॥]["''”’)\]]*$'))) / len(lines) END AS line_end_share,
   CASE WHEN solid <> '' AND ws IS NOT NULL THEN len(list_filter(plain, lambda x: list_contains(ws, x))) / len(plain) END AS common_share FROM b LEFT JOIN common USING (language))"""
_STATISTICS = ("words", "mean_word_length", "symbol_share", "line_end_share", "common_share")
_QUARTERS = ", ".join(f"quantile_disc({s}, {q}) AS {s}_{n}" for s in _STATISTICS for n, q in (("l", 0.25), ("m", 0.5), ("h", 0.75)))
_FLOORS = {"words": 1.0, "mean_word_length": 0.05, "symbol_share": 0.002, "line_end_share": 0.02, "common_share": 0.01}
_Z = ", ".join(f"({s} - {s}_m) / greatest({f}, CASE WHEN {s}_h > {s}_m THEN {s}_h - {s}_m ELSE {s}_m - {s}_l END / 0.6745) AS {s}_z" for s, f in _FLOORS.items())

ORACLE = {
    "p3_found": _P3,
    "p4_found": _P4,
    "p4_multiset": _P4_MULTISET,
    "p6_found": f"WITH {_SHARED} SELECT DISTINCT source_table, record_id FROM s",
    "p6_spans": f"WITH {_SHARED} SELECT * FROM spans",
    "p6_report": f"""WITH {_SHARED}, e AS (SELECT *, coalesce(max(span_end) OVER (PARTITION BY source_table, record_id ORDER BY span_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM spans), c AS (SELECT source_table, record_id, sum(greatest(0, span_end - greatest(span_start, before)))::BIGINT AS shared_chars FROM e GROUP BY 1, 2), l AS (SELECT source_table, record_id, coalesce(max(length(t)), 0) AS chars FROM r GROUP BY 1, 2)
      SELECT source_table, record_id, chars, coalesce(shared_chars, 0) AS shared_chars, CASE WHEN chars > 0 THEN least(1.0, coalesce(shared_chars, 0) / chars) ELSE 0.0 END AS shared FROM l LEFT JOIN c USING (source_table, record_id)""",
    "p10_stats": f"WITH {_STATS} SELECT doc_id, language, words, " + ", ".join(f"round({s}, 6) AS {s}" for s in _STATISTICS if s != "words") + " FROM st",
    "p10_found": f"""WITH {_STATS}, q AS (SELECT language, {_QUARTERS} FROM st WHERE words > 0 GROUP BY 1 HAVING count(*) >= 20), z AS (SELECT doc_id, {_Z} FROM st JOIN q USING (language) WHERE words > 0)
      SELECT DISTINCT doc_id FROM z WHERE mean_word_length_z < -6 OR mean_word_length_z > 20 OR symbol_share_z > 8 OR common_share_z < -4
        OR (words_z < -0.55)::INT + (abs(mean_word_length_z) > 4)::INT + (symbol_share_z > 4.5)::INT + (line_end_share_z < -0.6)::INT + (common_share_z < -3)::INT >= 3""",
}
