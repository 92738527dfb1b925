"""DuckDB SQL of the registered queries that SQL can express."""

from fieldcast.llm import quality_rules as Q

_OP3 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), grams AS (
  SELECT r, unnest(range(1, len(ws) - 1)) AS p, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS g
  FROM w WHERE len(ws) >= 3
), again AS (
  SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT p + o) AS n FROM again, (SELECT unnest([0, 1, 2]) AS o) GROUP BY r
), lines AS (
  SELECT r, source, regexp_replace(regexp_replace(lower(l), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '[\x20\x09-\x0D]+', ' ', 'g') AS flat
  FROM (SELECT r, source, unnest(ls) AS l FROM w)
), named AS (
  SELECT r, source, ('0x' || substr(md5(regexp_replace(flat, '[0-9]', '0', 'g')), 1, 15))::BIGINT AS line,
         length(flat) - length(replace(flat, ' ', '')) + 1 AS words
  FROM lines
), one AS (
  SELECT DISTINCT r, source, line, words FROM named
), sets AS (
  SELECT DISTINCT source, copy FROM (SELECT r, source, list_sort(list({{'line': line, 'words': words}})) AS copy FROM one GROUP BY r, source)
), apart AS (
  SELECT source, copy, l.line AS line, l.words AS words FROM (SELECT source, copy, unnest(copy) AS l FROM sets)
), shared AS (
  SELECT source, line FROM apart GROUP BY source, line HAVING count(*) >= {Q.LINE_DOCS}
), votes AS (
  SELECT source, copy, 100 * sum(CASE WHEN met THEN words ELSE 0 END) >= {Q.NEAR} * sum(words) AS alike, min(CASE WHEN met THEN line END) AS least
  FROM (SELECT a.*, s.line IS NOT NULL AS met FROM apart a LEFT JOIN shared s ON a.line = s.line AND a.source IS NOT DISTINCT FROM s.source) GROUP BY source, copy
), cast_ AS (
  SELECT DISTINCT a.source, a.line, v.alike, CASE WHEN v.alike THEN v.least END AS least, CASE WHEN NOT v.alike THEN v.copy END AS copy
  FROM apart a JOIN votes v ON a.copy = v.copy AND a.source IS NOT DISTINCT FROM v.source
), hosts AS (
  SELECT source, count(*) AS host_votes FROM (SELECT DISTINCT source, alike, least, copy FROM cast_) GROUP BY source
), common AS (
  SELECT c.source, c.line FROM (SELECT source, line, count(*) AS votes FROM cast_ GROUP BY source, line) c JOIN hosts h ON c.source IS NOT DISTINCT FROM h.source
  WHERE votes >= {Q.LINE_DOCS} AND 1000 * votes >= {Q.LINE_PERMILLE} * host_votes
), gone AS (
  SELECT r, sum(words) AS gone FROM named n JOIN common c ON n.line = c.line AND n.source IS NOT DISTINCT FROM c.source GROUP BY r
), figures AS (
  SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(covered.n, 0) AS n_repeat_words, coalesce(gone.gone, 0) AS n_line_words
  FROM w LEFT JOIN covered ON w.r = covered.r LEFT JOIN gone ON w.r = gone.r
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, (n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEATED} * n_words) AS base_failed, n_line_words::BIGINT AS n_line_words,
       (NOT (n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEATED} * n_words) AND 100 * (n_words - n_line_words) >= {Q.MIN_LEFT} * n_words) AS kept
FROM figures
"""

_OP8 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, k, array_to_string(ws[i : i + k - 1], ' ') AS g
  FROM (SELECT item_id, ws, least(len(ws), 10) AS k, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)
), places AS (
  SELECT r, k, i, array_to_string(ws[i : i + k - 1], ' ') AS g
  FROM (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM windows) WHERE len(ws) >= k)
), met AS (
  SELECT r, p.k, i, item_id FROM places p JOIN windows w ON p.k = w.k AND p.g = w.g
), hit AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, i, k FROM met)) GROUP BY r
), items AS (
  SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM met WHERE item_id IS NOT NULL GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.r = hit.r LEFT JOIN items ON d.r = items.r
"""

_OP2 = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages
), m AS (
  SELECT digest, max(page_id) AS largest FROM p GROUP BY digest
)
SELECT page_id, n::BIGINT AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM largest AND largest IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM largest THEN largest END AS refers_to
FROM p JOIN m ON p.digest = m.digest
"""

ORACLE: dict[str, str] = {
    "op2_warc_sequential": _OP2,
    "op3_line_frequency_rules": _OP3,
    "op8_index_decontamination": _OP8,
}
