"""DuckDB SQL of operators whose queries need more than a few lines."""

from __future__ import annotations


def crc32(text: str) -> str:
    """CRC-32 of a string in UTF-8, four bits of it at a time."""
    table = []
    for k in range(16):
        for _ in range(4):
            k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
        table.append(k)
    digits = f"hex(encode({text}))"  # the low half of each byte comes first
    halves = f"[strpos('0123456789ABCDEF', {digits}[CASE WHEN i % 2 = 1 THEN i + 1 ELSE i - 1 END]) - 1 for i in range(1, length({digits}) + 1)]"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {halves}::BIGINT[]), lambda c, b: xor(c >> 4, {table}[(xor(c, b) & 15) + 1])), 4294967295)"


STRUCTURE_REPAIR = rf"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS code
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS again
  FROM given WHERE code <> 0
), placed AS (
  SELECT coalesce(conv_id::VARCHAR, 'null') AS conv, turn, role, text, left(role, 1) AS initial,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS pos,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, again) AS nth,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS before
  FROM damaged
), marked AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
  FROM placed
), ways(q, inserted, made, icost, r) AS (  -- insertions before a row, from state q to state r
  VALUES ('', '', []::VARCHAR[], 0, ''), ('', 'I', ['user:'], 2, 'u'), ('', 'II', ['user:', 'assistant:'], 4, 'a'),
         ('s', '', [], 0, 's'), ('s', 'I', ['user:'], 2, 'u'), ('s', 'II', ['user:', 'assistant:'], 4, 'a'),
         ('u', '', [], 0, 'u'), ('u', 'I', ['assistant:'], 2, 'a'), ('a', '', [], 0, 'a'), ('a', 'I', ['user:'], 2, 'u')
), arcs(r, edit, initial, t) AS (
  VALUES ('', 'D', '', ''), ('s', 'D', '', 's'), ('u', 'D', '', 'u'), ('a', 'D', '', 'a'),
         ('', 'K', 's', 's'), ('', 'K', 'u', 'u'), ('s', 'K', 'u', 'u'), ('u', 'K', 'a', 'a'), ('a', 'K', 'u', 'u'),
         ('', 'R', '', 'u'), ('s', 'R', '', 'u'), ('u', 'R', '', 'a'), ('a', 'R', '', 'u')
), over AS (
  SELECT q, t, edit, initial, inserted || edit AS letters, made,
         icost + CASE edit WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END AS acost, t AS new_role
  FROM ways JOIN arcs ON ways.r = arcs.r
), best(conv, pos, state, way) AS (
  SELECT DISTINCT conv, 0::BIGINT, '', {{'cost': 0::BIGINT, 'audit': '', 'made': []::VARCHAR[]}} FROM placed
  UNION ALL
  SELECT b.conv, b.pos + 1, o.t, min({{
      'cost': b.way.cost + o.acost + CASE WHEN m.fault = 'truncated' AND o.edit <> 'D' THEN 1 ELSE 0 END,
      'audit': b.way.audit || o.letters,
      'made': list_concat(b.way.made, o.made, CASE o.edit WHEN 'K' THEN [m.role || ':' || m.text]
          WHEN 'R' THEN [CASE o.new_role WHEN 'u' THEN 'user:' ELSE 'assistant:' END || m.text] ELSE [] END)}})
  FROM best b JOIN marked m ON m.conv = b.conv AND m.pos = b.pos + 1 JOIN over o ON o.q = b.state
  WHERE (o.edit = 'D' OR m.fault NOT IN ('blank', 'duplicate')) AND (o.edit <> 'K' OR o.initial = m.initial)
  GROUP BY b.conv, b.pos, o.t
), whole AS (
  SELECT b.conv, min({{'cost': b.way.cost + w.icost, 'audit': b.way.audit || w.inserted, 'made': list_concat(b.way.made, w.made)}}) AS way
  FROM best b JOIN (SELECT conv, max(pos) AS last FROM placed GROUP BY conv) l ON b.conv = l.conv AND b.pos = l.last
  JOIN ways w ON w.q = b.state WHERE w.r IN ('', 'a') GROUP BY b.conv
), counted AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n_rows
  FROM marked GROUP BY conv
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(way.cost, 0) AS cost,
       coalesce(way.audit, '') AS audit, sha256(coalesce(array_to_string(way.made, chr(10)), '')) AS repaired_sha256,
       coalesce(n_rows, 0) AS n_rows
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN counted k ON k.conv = coalesce(c.conv_id::VARCHAR, 'null') LEFT JOIN whole w ON w.conv = coalesce(c.conv_id::VARCHAR, 'null')
"""

SPELLING_VARIANTS = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents
), per_document AS (
  SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL
), hashed AS (
  SELECT run, n, {crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM per_document
), words AS MATERIALIZED (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word,
         sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5
), without AS MATERIALIZED (
  SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT *, unnest(range(length(word))) AS i FROM words)
), near AS MATERIALIZED (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM without a JOIN without b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM without a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM without a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, n, count(*) AS n_near, min({{'minus': -other_n, 'form': other}}) AS b FROM near GROUP BY word, n
), forms AS MATERIALIZED (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.minus >= 5 * words.n THEN b.form END AS form,
         CASE WHEN -b.minus >= 5 * words.n THEN -b.minus END::BIGINT AS form_n
  FROM words LEFT JOIN best ON words.word = best.word
), chain(word, root) AS (
  SELECT word, word FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON c.root = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM forms f JOIN chain c ON c.word = f.word JOIN forms e ON e.word = c.root AND e.form IS NULL
"""
