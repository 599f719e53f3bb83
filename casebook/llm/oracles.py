"""DuckDB SQL of the operators that SQL can express, on the tables of the driver."""

from __future__ import annotations

from casebook.llm.collocations import ABSORB_PERCENT, MAX_WORDS, MIN_COUNT, TOP
from casebook.llm.line_dedup import MIN_LINES, MIN_WORDS
from casebook.llm.mixing import MAX_EPOCHS, SEED, WEIGHTS
from casebook.llm.quality_rules import STOP_WORDS

FORMS = ", ".join(f"'{f}'" for f in sorted({f for w in STOP_WORDS for f in (w, w.capitalize())}))

QUALITY = rf"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
    FROM documents
), g AS (
    SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
    FROM d, unnest(range(1, len(ws) - 1)) u(i)
), r AS (
    SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1
), c AS (
    SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id
), m AS (
    SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        length(regexp_replace(text, '[^!?]', '', 'g'))::BIGINT AS n_marks,
        length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g'))::BIGINT AS n_upper,
        len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1]))::BIGINT AS n_same,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines,
        coalesce(c.n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(ws, lambda x: x IN ({FORMS})))::BIGINT AS n_stop
    FROM d LEFT JOIN c ON c.doc_id = d.doc_id
), b AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND word_chars / n_words BETWEEN 2.0 AND 14.0 AND n_symbols / n_words <= 0.1 AND n_stop / n_words >= 0.02
        AND n_marks / word_chars <= 0.1 AND n_repeat_words / n_words <= 0.5 AND n_dup_lines / n_lines <= 0.5
        AND n_upper / word_chars <= 0.3 AND n_same / n_words <= 0.2 AS kept
FROM b
"""

MIX = rf"""
WITH z AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        md5(doc_id::VARCHAR || '|{SEED}') AS key
    FROM documents
), s AS (
    SELECT source, sum(size)::BIGINT AS source_size,
        [{", ".join(map(str, WEIGHTS))}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}]::BIGINT AS weight
    FROM z GROUP BY source
), o AS (
    SELECT *, {MAX_EPOCHS} * source_size AS ceiling,
        row_number() OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST) AS i FROM s
), p AS (
    -- with the i - 1 first sources clamped: what is left for how much weight
    SELECT *, (SELECT sum(source_size) FROM s) - coalesce(sum(ceiling) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
        sum(weight) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
    FROM o
), k AS (
    SELECT rest, free, i FROM p WHERE weight * rest <= ceiling * free ORDER BY i LIMIT 1
), t AS (
    SELECT o.source, o.source_size,
        CASE WHEN o.i < k.i THEN o.ceiling::DOUBLE ELSE o.weight::DOUBLE * k.rest::DOUBLE / k.free::DOUBLE END AS target
    FROM o, k
), e AS (
    SELECT z.doc_id, z.size, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS whole,
        coalesce(sum(z.size) OVER (PARTITION BY z.source ORDER BY z.key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source
), f AS (
    SELECT *, target - whole * source_size AS missing FROM e
), h AS (
    SELECT *, least(whole + CASE WHEN missing > 0 AND before + size / 2 <= missing THEN 1 ELSE 0 END, {MAX_EPOCHS})::BIGINT AS copies FROM f
)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM h
"""

LINES = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
a AS (SELECT doc_id, i AS place, ls[i] AS line, regexp_replace(ls[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS x
    FROM d, unnest(range(1, len(ls) + 1)) u(i)),
l AS (SELECT doc_id, place, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n,
    row_number() OVER (PARTITION BY doc_id ORDER BY place) AS pos, count(*) OVER (PARTITION BY doc_id) AS lines
    FROM a WHERE x <> ''),
g AS (SELECT doc_id, list(x ORDER BY pos) AS xs, list(n ORDER BY pos) AS ns, list(place ORDER BY pos) AS ps FROM l GROUP BY doc_id),
w AS (SELECT doc_id, pos, xs, ps,
    coalesce(list_extract(list_filter(range(1, {MIN_LINES} + 1), lambda k: k = {MIN_LINES} OR list_sum(ns[pos:pos + k - 1]) >= {MIN_WORDS}), 1), 0) AS size,
    coalesce(list_extract(list_filter(range(1, {MIN_LINES} + 1), lambda k: k = {MIN_LINES} OR list_sum(ns[greatest(pos - k + 1, 1):pos]) >= {MIN_WORDS}), 1), 0) AS back
    FROM g, unnest(range(1, len(xs) + 1)) u(pos)),
v AS (SELECT doc_id, pos, ps[pos:pos + size - 1] AS held, xs[pos:pos + size - 1] AS content FROM w WHERE pos + size - 1 <= len(xs)
    UNION SELECT doc_id, pos - back + 1, ps[pos - back + 1:pos], xs[pos - back + 1:pos] FROM w WHERE pos >= back),
r AS (SELECT doc_id, held FROM v QUALIFY row_number() OVER (PARTITION BY content ORDER BY doc_id, pos) > 1),
x AS (SELECT DISTINCT doc_id, unnest(held) AS place FROM r)
SELECT a.doc_id, count(x.place)::INTEGER AS n_deleted,
    coalesce(string_agg(a.line, chr(10) ORDER BY a.place) FILTER (WHERE x.place IS NULL), '') AS text
FROM a LEFT JOIN x ON x.doc_id = a.doc_id AND x.place = a.place GROUP BY a.doc_id
"""

NEAR = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
    FROM documents
), g AS (
    SELECT DISTINCT doc_id, ws[i] || ' ' || ws[i + 1] AS gram FROM d, unnest(range(1, len(ws))) u(i)
    UNION ALL
    SELECT doc_id, ws[1] FROM d WHERE len(ws) = 1
), n AS (
    SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), p AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
    SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 80 * (x.n + y.n - k)
), sides AS (
    SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), c AS (
    SELECT a AS doc_id, a AS reached FROM sides
    UNION
    SELECT c.doc_id, sides.b FROM c JOIN sides ON sides.a = c.reached
), m AS (
    SELECT doc_id, min(reached) AS least FROM c GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.least, d.doc_id)::BIGINT AS component_id,
    coalesce(m.least, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""

PHRASES = rf"""
WITH p AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), w AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
), t AS (
    SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang
), g AS (
    SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
    FROM w, unnest(range(1, {MAX_WORDS} + 1)) s(k), unnest(range(1, len(ws) - k + 2)) u(i)
), f AS (
    SELECT lang, k, phrase, count(*)::BIGINT AS a FROM g GROUP BY ALL HAVING count(*) >= {MIN_COUNT}
), c AS (
    SELECT lang, k, phrase, a, j, string_split(phrase, ' ') AS ws FROM f, unnest(range(1, k)) u(j)
), s AS (
    SELECT c.lang, c.k, c.phrase, c.a, j, x.a AS l, y.a AS r, ((2000000::HUGEINT * c.a) // (x.a::HUGEINT + y.a))::BIGINT AS score
    FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:j], ' ')
        JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[j + 1:], ' ')
    QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, j) = 1
), o AS (
    SELECT * FROM s WHERE NOT EXISTS (
        SELECT 1 FROM f WHERE f.lang = s.lang AND f.k > s.k AND contains(' ' || f.phrase || ' ', ' ' || s.phrase || ' ')
            AND 100::HUGEINT * f.a >= {ABSORB_PERCENT}::HUGEINT * s.a)
), r AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o
)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM r JOIN t ON t.lang = r.lang WHERE rank <= {TOP}
"""

SQL = {
    "op2_quality_rules": QUALITY, "op4_source_mix": MIX, "op6_line_dedup": LINES, "op9_near_duplicates": NEAR,
    "op13_collocations": PHRASES,
}
