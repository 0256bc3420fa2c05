"""Expected results in DuckDB SQL, for the corpus queries that SQL can express.

The others are models, approximations, or need functions SQL lacks (byte-pair merges, XXH64); their
tests compare with brute force, round trips, public libraries or held-out accuracy.
"""

from __future__ import annotations

# Tokens of a line with the variable ones open; hashes are not needed here.
LINE_DEDUP = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
bare AS (
  SELECT doc_id, pos, trim(translate(line, chr(9) || chr(13), '  '), ' ') AS b FROM lines),
opened AS (
  SELECT doc_id, pos, b, regexp_replace(b, '[^ ]*[0-9][^ ]*', '<*>', 'g') AS o
  FROM bare WHERE b <> ''),
tokens AS (
  SELECT doc_id, pos, b, o, string_split(o, ' ') AS t, len(string_split(o, ' ')) AS n,
         (length(o) - length(replace(o, '<*>', ''))) // 3 AS marks
  FROM opened),
sized AS (
  SELECT *, n - marks AS fixed, greatest(n - 3, 0) AS rest,
         least((greatest(n - 3, 0) + 2) // 3, n * 3 // 10) AS w,
         [n::VARCHAR] || t[1:3] AS leaf FROM tokens),
windows AS (
  SELECT *, unnest([0, (rest - w) // 2, rest - w]) AS start, unnest([1, 2, 3]) AS number
  FROM sized WHERE w > 0 AND 3 * (fixed - w) >= 2 * n AND fixed - w >= 8),
keys AS (
  SELECT doc_id, pos, n >= 50 AS passage, leaf || ['0', CASE WHEN 2 * fixed >= n AND fixed >= 4
           THEN o ELSE b END] AS key FROM sized
  UNION ALL
  SELECT doc_id, pos, false, leaf || [number::VARCHAR] || t[1:3 + start] || ['...']
           || t[4 + start + w:] FROM windows),
recurring AS (
  SELECT key, min({'d': doc_id, 'a': pos}) AS first FROM keys GROUP BY key
  HAVING count(DISTINCT doc_id) >= CASE WHEN bool_or(passage) THEN 2 ELSE 3 END),
dropped AS (
  SELECT DISTINCT k.doc_id, k.pos FROM keys k JOIN recurring r ON k.key = r.key
  WHERE r.first <> {'d': k.doc_id, 'a': k.pos}),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text
  FROM lines l ANTI JOIN dropped d ON l.doc_id = d.doc_id AND l.pos = d.pos GROUP BY l.doc_id)
SELECT o.doc_id, coalesce(len(string_split(o.text, chr(10))), 0)::BIGINT AS n_lines,
       length(CASE WHEN o.text IS NOT NULL THEN coalesce(k.text, '') END)::BIGINT AS n_chars,
       sha256(CASE WHEN o.text IS NOT NULL THEN coalesce(k.text, '') END) AS text_sha256
FROM documents o LEFT JOIN kept k ON o.doc_id = k.doc_id
"""

# The bits of the digest, five at a time, name the letters.
WARC = """
WITH pages0 AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages),
sums AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS sum FROM pages0),
bits AS (
  SELECT *, array_to_string(list_transform(string_split(sum, ''), lambda c: ['0000', '0001',
    '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100',
    '1101', '1110', '1111'][strpos('0123456789abcdef', c)]), '') AS b FROM sums),
named AS (
  SELECT *, array_to_string(list_transform(range(0, 160, 5), lambda i:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * b[i + 1]::INT + 8 * b[i + 2]::INT
      + 4 * b[i + 3]::INT + 2 * b[i + 4]::INT + b[i + 5]::INT]), '') AS payload_digest,
    max(page_id) OVER (PARTITION BY sum, payload_bytes) AS first
  FROM bits)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM named
"""

_CONTROL = (r"([<\[])(\\*)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]"
            r"|/INST\]|<SYS>>|</SYS>>)")
CHAT = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'),
                   (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
escaped AS (
  SELECT *, regexp_replace(role, '{_CONTROL}', '\\1\\\\\\2\\3', 'g') AS r,
         regexp_replace(text, '{_CONTROL}', '\\1\\\\\\2\\3', 'g') AS e FROM said)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
    AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'),
                  '')) AS loss_sha256,
  sum(length('<|im_start|><|im_sep|><|im_end|>') + length(r) + length(e))::BIGINT
    AS formatted_chars
FROM escaped GROUP BY conv_id
"""

TOP_K = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, r.vec_id,
         list_inner_product(q.v, r.v)::BIGINT AS score
  FROM whole q JOIN whole r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank,
       vec_id, score
FROM scored
QUALIFY rank <= 5
"""

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
# Two shares differ by less than 2**30, so their square needs no more than a HUGEINT.
DIVERGENCE = f"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), {_AZ}),
                            '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM documents),
words AS (SELECT d, lang, source, unnest(words) AS term FROM docs),
kept AS (
  SELECT lang, term, count(*) AS lang_n FROM words GROUP BY ALL HAVING count(DISTINCT d) >= 10),
sizes AS (SELECT lang, count(*) AS v, sum(lang_n) AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counted AS (
  SELECT g.lang, g.source, k.term, k.lang_n, coalesce(c.n, 0) AS n
  FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN (
    SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL) c
  ON g.lang = c.lang AND g.source = c.source AND k.term = c.term),
shares AS (
  SELECT c.lang, source, term, n,
    1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY c.lang, source) + 2 * v) AS p,
    1 + (1000000000::HUGEINT * (lang_n + 2)) // (total + 2 * v) AS q
  FROM counted c JOIN sizes s ON c.lang = s.lang),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p
  ON a.lang = p.lang AND a.source = p.source AND b.source = p.item
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (
  PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM found QUALIFY part = 'pair' OR rank <= 10
"""

_RUNS = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"
DECONTAMINATION = f"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_RUNS}) AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_RUNS}) AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id::VARCHAR AS item, least(len(w), 10) AS size, unnest(list_transform(
    range(1, greatest(len(w) - 10, 0) + 2), lambda i: array_to_string(w[i:i + 9], ' '))) AS words
  FROM items WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS pos, w
  FROM docs, sizes WHERE len(w) >= size),
met AS (
  SELECT p.doc_id, p.pos, p.size, x.item FROM places p JOIN windows x
  ON p.size = x.size AND array_to_string(p.w[p.pos:p.pos + p.size - 1], ' ') = x.words),
hits AS (
  SELECT doc_id, count(DISTINCT word) AS n FROM (
    SELECT doc_id, unnest(range(pos, pos + size)) AS word FROM met) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (
    SELECT DISTINCT doc_id, item FROM met) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit,
       coalesce(i.n, 0)::BIGINT AS n_items, sha256(coalesce(i.items, '')) AS items_sha256,
       coalesce(h.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hits h ON d.doc_id = h.doc_id LEFT JOIN named i ON d.doc_id = i.doc_id
"""

SQL: dict[str, str] = {
    "op2_line_dedup": LINE_DEDUP,
    "op3_warc_round_trip": WARC,
    "op4_chat_format": CHAT,
    "op7_exact_top_k": TOP_K,
    "op11_source_divergence": DIVERGENCE,
    "op13_decontamination": DECONTAMINATION,
}
