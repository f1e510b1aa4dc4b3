"""DuckDB SQL for the operators that SQL can express on whole tables."""

from __future__ import annotations

from .line_quality import HOST_SHARE, MAX_REPEAT_PERCENT, MIN_DOCUMENTS, MIN_LEFT_PERCENT, MIN_WORDS
from .minhash import PERCENT, SHINGLE
from .substring_dedup import WINDOW

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_LOWER}')"


def _words(text: str) -> str:
    return f"regexp_extract_all(coalesce({text}, ''), '{_WORD}')"


def _normal(text: str) -> str:
    """Words of a normalised line, joined."""
    return rf"array_to_string(regexp_extract_all(regexp_replace({_lower(text)}, '[0-9]', '0', 'g'), '{_WORD}'), ' ')"


ORACLE = {}

ORACLE["op1_line_frequency"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, source, {_words('text')} AS w FROM documents),
grams AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g
          FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, CAST(count(DISTINCT i + k) AS BIGINT) AS n
            FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
lines AS (SELECT doc_id, source, line, {_normal('line')} AS norm, {_normal('text')} AS content
          FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d)),
held AS (SELECT *, len(string_split(norm, ' ')) AS n FROM lines WHERE norm <> ''),
dups AS (SELECT doc_id, CAST(count(*) - count(DISTINCT line) AS BIGINT) AS n FROM held GROUP BY doc_id),
size AS (SELECT source, count(DISTINCT content) AS size FROM held GROUP BY source),
freq AS (SELECT h.source, h.norm, min(h.doc_id) AS first FROM held h JOIN size s ON h.source IS NOT DISTINCT FROM s.source
         GROUP BY h.source, h.norm, s.size
         HAVING count(DISTINCT h.content) > {MIN_DOCUMENTS} AND count(DISTINCT h.content) > {HOST_SHARE} * s.size),
gone AS (SELECT h.doc_id, CAST(sum(h.n) AS BIGINT) AS n FROM held h
         JOIN freq f ON h.norm = f.norm AND h.source IS NOT DISTINCT FROM f.source WHERE h.doc_id <> f.first
         GROUP BY h.doc_id),
base AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                coalesce(u.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, coalesce(g.n, 0) AS n_removed_words
         FROM d LEFT JOIN dups u ON d.doc_id = u.doc_id LEFT JOIN covered c ON d.doc_id = c.doc_id
         LEFT JOIN gone g ON d.doc_id = g.doc_id),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT 100 * (n_words - n_removed_words) < {MIN_LEFT_PERCENT} * n_words AS kept, n_removed_words
FROM judged"""

ORACLE["op3_minhash"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(_lower('text'))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS g FROM (
        SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
         GROUP BY a.doc_id, b.doc_id),
link AS (SELECT p.a, p.b FROM pair p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id
         WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
near AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS id, doc_id AS other FROM d UNION
          SELECT reach.id, near.b FROM reach JOIN near ON reach.other = near.a)
SELECT id AS doc_id, coalesce(n.n, 0) AS n_shingles, min(other) AS component_id, id = min(other) AS kept
FROM reach LEFT JOIN n ON reach.id = n.doc_id GROUP BY id, n.n"""

ORACLE["op10_substring_dedup"] = f"""
WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS g FROM (
              SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
repeated AS (SELECT doc_id, i FROM windows QUALIFY doc_id > min(doc_id) OVER (PARTITION BY g)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
last AS (SELECT words.doc_id, words.word, words.i, r.i AS start FROM words
         ASOF LEFT JOIN repeated r ON words.doc_id = r.doc_id AND words.i >= r.i),
marked AS (SELECT doc_id, word, i, coalesce(i - start < {WINDOW}, false) AS gone FROM last),
kept AS (SELECT doc_id, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed,
                coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS text FROM marked GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(k.n_removed, 0) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id"""
