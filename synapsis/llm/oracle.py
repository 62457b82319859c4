"""SQL of those queries of this folder that SQL can express, written from their definitions for DuckDB."""

from __future__ import annotations

from .mixing import BLOCK, GOLDEN, LIMIT, RING, SLOTS
from .quality import LINE_CHAR_SHARE, LINE_SHARE, NGRAM_SHARE

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING = f"""
WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM d),
windows AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM d)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM windows) WHERE n > 1),
marked AS (SELECT w.doc_id, w.i, w.w, coalesce(max(l.s) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) > 0 AS gone FROM w LEFT JOIN later l ON l.doc_id = w.doc_id AND l.s = w.i)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(m.n, 0)::BIGINT AS n_removed, sha256(coalesce(m.kept, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(w, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM marked GROUP BY 1) m USING (doc_id)
"""

BYTES = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pairs AS (SELECT doc_id, n, j, substring(h, 400 * j + 1, 800) AS two FROM (SELECT doc_id, h, len(h) // 2 AS n, unnest(range(0, (len(h) + 399) // 400)) AS j FROM d)),
b AS (SELECT doc_id, n, two, o, 200 * j + o AS i FROM (SELECT *, unnest(range(0, 200)) AS o FROM pairs) WHERE 200 * j + o < n),
windows AS (SELECT doc_id, i, md5(substring(two, 2 * o + 1, 400)) AS k FROM b WHERE i + 200 <= n),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n FROM windows) WHERE n > 1),
marked AS (SELECT b.doc_id, b.i, substring(b.two, 2 * b.o + 1, 2) AS x, coalesce(max(a.i) OVER (PARTITION BY b.doc_id ORDER BY b.i ROWS BETWEEN 199 PRECEDING AND CURRENT ROW), -1) >= 0 AS gone FROM b LEFT JOIN again a ON a.doc_id = b.doc_id AND a.i = b.i),
edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM marked)
SELECT d.doc_id, (len(d.h) // 2)::BIGINT AS n_bytes, coalesce(m.n, 0)::BIGINT AS n_removed, coalesce(m.spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(m.kept, ''))) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) FILTER (gone) AS n, count(*) FILTER (opens) AS spans, string_agg(x, '' ORDER BY i) FILTER (NOT gone) AS kept FROM edges GROUP BY 1) m USING (doc_id)
"""


def _grams(n: int, later: bool) -> str:
    """Words (or, for ``later``, characters) inside n-grams that are repeated: any place, or places after the first."""
    k = f"g{n}"
    found = f"row_number() OVER (PARTITION BY doc_id, {k} ORDER BY i) > 1" if later else f"count(*) OVER (PARTITION BY doc_id, {k}) > 1"
    return f"(SELECT doc_id, {'sum(length(w))' if later else 'count(*)'} AS n FROM (SELECT doc_id, w, coalesce(max(CASE WHEN hit THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 0) > 0 AS inside FROM (SELECT doc_id, i, w, g{n} IS NOT NULL AND {found} AS hit FROM grams)) WHERE inside GROUP BY 1)"


QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS ws FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM d),
grams AS (SELECT doc_id, i, w, {', '.join("w || ' ' || " + " || ' ' || ".join(f'lead(w, {a}) OVER o' for a in range(1, n)) + f' AS g{n}' for n in NGRAM_SHARE)} FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
chars AS (SELECT doc_id, sum(length(w)) AS word_chars FROM w GROUP BY 1),
lines AS (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id, x) > 1 AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]')),
l AS (SELECT doc_id, count(*) AS n, sum(length(x)) AS chars, count(*) FILTER (dup) AS dups, coalesce(sum(length(x)) FILTER (dup), 0) AS dup_chars FROM lines GROUP BY 1),
m AS (SELECT d.doc_id, len(d.ws) AS n_words, coalesce(chars.word_chars, 0)::BIGINT AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.dups, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
coalesce(l.n, 0) AS n_lines, coalesce(l.chars, 0) AS line_chars, coalesce(l.dup_chars, 0)::BIGINT AS dup_line_chars, {', '.join(f'coalesce(g{n}.n, 0) AS g{n}' for n in NGRAM_SHARE)}
FROM d LEFT JOIN chars USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN {_grams(5, False)} r USING (doc_id) {' '.join(f'LEFT JOIN {_grams(n, True)} g{n} USING (doc_id)' for n in NGRAM_SHARE)}),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, dup_line_chars,
NOT (base_failed OR n_dup_lines > {LINE_SHARE}::DOUBLE * n_lines OR dup_line_chars > {LINE_CHAR_SHARE}::DOUBLE * line_chars OR {' OR '.join(f'g{n} > {s}::DOUBLE * word_chars' for n, s in NGRAM_SHARE.items())}) AS kept
FROM v
"""

MIXING = f"""
WITH sized AS (SELECT doc_id, source, len({WORDS}) AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY 1),
p AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS place FROM src),
q AS (SELECT *, (place - 1) % 3 + 1 AS weight, {LIMIT} * source_size AS cap, (sum(source_size) OVER ())::BIGINT AS total FROM p),
o AS (SELECT *, total - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(weight) OVER (ORDER BY cap::DOUBLE / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS shares FROM q),
c AS (SELECT *, cap * shares <= rest * weight AS capped FROM o),
t AS (SELECT *, CASE WHEN capped THEN cap::DOUBLE ELSE (total - coalesce(sum(cap) FILTER (capped) OVER (), 0))::DOUBLE * weight::DOUBLE / (sum(weight) FILTER (NOT capped) OVER ())::DOUBLE END AS target FROM c),
u AS (SELECT *, CASE WHEN place = count(*) OVER () THEN {RING} ELSE round(sum(target) OVER (ORDER BY place) / greatest(total, 1) * {RING})::BIGINT END AS high FROM t),
g AS (SELECT *, coalesce(lag(high) OVER (ORDER BY place), 0) AS low FROM u),
k AS (SELECT greatest(1, least({BLOCK}, (max(total) + {SLOTS - 1}) // {SLOTS})) AS b, max(total) AS total FROM g),
slots AS (SELECT j, (j % {RING}) * {GOLDEN} % {RING} AS x FROM (SELECT unnest(range(0, (total + b - 1) // b)) AS j FROM k)),
ranked AS (SELECT place, (source_size + b - 1) // b AS blocks, row_number() OVER (PARTITION BY place ORDER BY j) - 1 AS r FROM slots JOIN g ON x >= low AND x < high AND source_size > 0 CROSS JOIN k),
taken AS (SELECT place, r % blocks AS block, count(*) AS times FROM ranked WHERE r < {LIMIT} * blocks GROUP BY 1, 2),
rows AS (SELECT s.doc_id, s.source, s.size, g.place, g.source_size, g.target, coalesce(sum(s.size) OVER (PARTITION BY g.place ORDER BY md5(coalesce(s.doc_id::VARCHAR, '')), s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin FROM sized s JOIN g ON s.source IS NOT DISTINCT FROM g.source),
pieces AS (SELECT place, begin, size, b, unnest(range(begin // b, (begin + size - 1) // b + 1)) AS block FROM rows CROSS JOIN k WHERE size > 0),
got AS (SELECT place, begin, sum((least(begin + size, (block + 1) * b) - greatest(begin, block * b)) * times)::BIGINT AS taken FROM pieces JOIN taken USING (place, block) GROUP BY 1, 2)
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE coalesce(taken, 0) END AS taken FROM rows LEFT JOIN got USING (place, begin)
"""

ORACLE_SQL = {
    "op4_substring_dedup": SUBSTRING,
    "op5_suffix_array_dedup": BYTES,
    "op6_quality_rules": QUALITY,
    "op10_source_mixing": MIXING,
}
