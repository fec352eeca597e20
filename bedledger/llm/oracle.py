"""DuckDB SQL of the queries that SQL can express; the doc_id of the test tables is unique."""

from __future__ import annotations

from bedledger.llm.quality import LEFT_SHARE, LEFT_WORDS, LINE_DOCUMENTS, MIN_WORDS

_WORD = r"'[^\x20\x09-\x0D]+'"
# after lower-casing A-Z
_ITEM_WORD = r"'[0-9a-z\x{80}-\x{10FFFF}]+'"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINE_QUALITY = rf"""
WITH d AS (
    SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
windows AS (
    SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
twice AS (
    SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
repeated AS (
    SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
lines AS (
    SELECT * FROM (
        SELECT doc_id, source, t, line, len(regexp_extract_all(line, {_WORD})) AS n,
               trim(regexp_replace(lower(line), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS k
        FROM (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS line FROM d))
    WHERE n > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
common AS (
    SELECT source, k FROM lines WHERE k <> '' GROUP BY source, k HAVING count(DISTINCT t) > {LINE_DOCUMENTS}),
removed AS (
    SELECT doc_id, sum(n) AS n FROM lines l JOIN common c ON l.k = c.k AND l.source IS NOT DISTINCT FROM c.source
    GROUP BY doc_id),
counted AS (
    SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
           length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
           coalesce(dup.n, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words,
           CAST(len(w) - coalesce(removed.n, 0) AS BIGINT) AS n_words_left
    FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN removed USING (doc_id)),
judged AS (
    SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT *, NOT base_failed AND n_words_left >= {LEFT_WORDS} AND n_words_left >= {LEFT_SHARE} * n_words AS kept
FROM judged"""

WINNOWING = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ITEM_WORD}) AS w FROM documents),
b AS (
    SELECT item, w, least(10, len(w)) AS n
    FROM (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, {_ITEM_WORD}) AS w FROM benchmark)
    WHERE len(w) > 0),
wanted AS (
    SELECT DISTINCT item, n, array_to_string(w[j:j + n - 1], ' ') AS k
    FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS j FROM b)),
seen AS (
    SELECT doc_id, j, n, array_to_string(w[j:j + n - 1], ' ') AS k
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS j
          FROM d, (SELECT DISTINCT n FROM wanted) WHERE len(w) >= n)),
met AS (SELECT doc_id, j, n, item FROM seen JOIN wanted USING (n, k)),
hits AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + n)) AS p FROM met) GROUP BY doc_id),
items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS told
    FROM (SELECT DISTINCT doc_id, item FROM met) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(told, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)"""

CHAT_FORMAT = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL
    SELECT -7, turn, role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(turn, role))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       -- heading, separator and end mark have 14 characters; each escaped character takes one more
       CAST(sum(14 + length(role) + length(text) + length(regexp_replace(role, '[^\\#<:]', '', 'g'))
                + length(regexp_replace(text, '[^\\#<]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""

HARD_NEGATIVES = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e,
           CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
           CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
    SELECT * FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.other_id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank,
       n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same
WHERE 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) <= 3"""

RANKED_SEARCH = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ITEM_WORD}) AS t FROM documents),
sized AS (SELECT doc_id, t, len(t) AS n FROM d WHERE len(t) > 0),
whole AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sized),
wanted AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, {_ITEM_WORD})) AS term FROM benchmark),
tf AS (
    SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM sized)
    WHERE term IN (SELECT term FROM wanted) GROUP BY doc_id, n, term),
weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
    FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), whole),
scored AS (
    SELECT item_id, doc_id,
           CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
    FROM wanted JOIN tf USING (term) JOIN weights USING (term), whole GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10"""

GRACE_DEDUP = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
grouped AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN grouped USING (t)"""

ORACLE_SQL: dict[str, str] = {
    "op1_line_quality": LINE_QUALITY,
    "op5_winnowing": WINNOWING,
    "op10_chat_format": CHAT_FORMAT,
    "op11_hard_negatives": HARD_NEGATIVES,
    "op12_ranked_search": RANKED_SEARCH,
    "op13_grace_dedup": GRACE_DEDUP,
}
