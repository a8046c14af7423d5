"""DuckDB SQL of the text operators, written from their definitions."""

from __future__ import annotations

#: Words as the operators take them: split on the six ASCII white-space
#: characters.
OP8 = r"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM base
), grams AS (
  SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3
), keyed AS (
  SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM grams
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM keyed) WHERE n > 1
), covered AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid
), s AS (
  SELECT w.rid, doc_id, lang, source, len(ws)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered USING (rid)
), pm AS (
  SELECT *, n_symbols * 1000 // greatest(word_chars, 1) AS pm_symbols, n_dup_lines * 1000 // greatest(n_lines, 1) AS pm_dup_lines,
         n_repeat_words * 1000 // greatest(n_words, 1) AS pm_repeats
  FROM s
), passed AS (
  SELECT * FROM pm WHERE NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
), each AS (
  SELECT lang, source, 'symbols' AS f, 0.90 AS level, 20 AS tolerance, pm_symbols AS v FROM passed
  UNION ALL SELECT lang, source, 'dup_lines', 0.95, 250, pm_dup_lines FROM passed
  UNION ALL SELECT lang, source, 'repeats', 0.95, 100, pm_repeats FROM passed
), placed AS (
  SELECT lang, source, f, level, tolerance, v,
         row_number() OVER (PARTITION BY lang, source, f ORDER BY v) AS i, count(*) OVER (PARTITION BY lang, source, f) AS n,
         row_number() OVER (PARTITION BY lang, f ORDER BY v) AS il, count(*) OVER (PARTITION BY lang, f) AS nl,
         row_number() OVER (PARTITION BY f ORDER BY v) AS ia, count(*) OVER (PARTITION BY f) AS na
  FROM each
), own AS (
  SELECT lang, source, f, max(tolerance) AS tolerance, max(n) AS n,
         (4 * min(v) FILTER (i >= level * n) - 3 * min(v) FILTER (i >= 0.5 * n))::BIGINT AS tail
  FROM placed GROUP BY lang, source, f
), by_lang AS (
  SELECT lang, f, max(nl) AS n, (4 * min(v) FILTER (il >= level * nl) - 3 * min(v) FILTER (il >= 0.5 * nl))::BIGINT AS tail
  FROM placed GROUP BY lang, f
), everywhere AS (
  SELECT f, (4 * min(v) FILTER (ia >= level * na) - 3 * min(v) FILTER (ia >= 0.5 * na))::BIGINT AS tail FROM placed GROUP BY f
), chosen AS (
  SELECT own.lang, own.source, own.f,
         own.tolerance + (own.n * own.tail + 200 * ((l.n * l.tail + 200 * a.tail) // (l.n + 200))) // (own.n + 200) AS fence
  FROM own JOIN by_lang l ON own.lang IS NOT DISTINCT FROM l.lang AND own.f = l.f JOIN everywhere a ON a.f = own.f
), fences AS (
  SELECT lang, source, max(fence) FILTER (f = 'symbols') AS a, max(fence) FILTER (f = 'dup_lines') AS b,
         max(fence) FILTER (f = 'repeats') AS c
  FROM chosen GROUP BY ALL
), judged AS (
  SELECT pm.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         concat_ws(',', CASE WHEN pm_symbols > a THEN 'symbols' END, CASE WHEN pm_dup_lines > b THEN 'dup_lines' END,
                   CASE WHEN pm_repeats > c THEN 'repeats' END) AS reasons
  FROM pm LEFT JOIN fences ON pm.lang IS NOT DISTINCT FROM fences.lang AND pm.source IS NOT DISTINCT FROM fences.source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND reasons = '' AS kept, reasons
FROM judged
"""


def op4(sentences: dict[str, str], rules: list[tuple[str, list[str]]]) -> str:
    """The licence scan over every sentence and pattern."""
    known = ", ".join(f"('{k}', '{p}')" for k, p in sentences.items())
    rows = ", ".join(f"('{name}', ',{','.join(ids)},')" for name, ids in rules)
    return rf"""
WITH known(sentence_id, pattern) AS (VALUES {known}), rules(license, ids) AS (VALUES {rows}),
broken AS (
  SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '\n[ \t\r]*\n', chr(1), 'g'), '([.!?;:])[ \t\r\n]+', '\1' || chr(1), 'g') AS t
  FROM documents
), raw AS (
  SELECT doc_id, unnest(string_split(t, chr(1))) AS raw, generate_subscripts(string_split(t, chr(1)), 1) AS pos FROM broken
), cut AS (
  SELECT doc_id, pos, CASE WHEN contains(raw, chr(10)) THEN list_prepend(raw, string_split(raw, chr(10))) ELSE [raw] END AS p FROM raw
), pieces AS (
  SELECT doc_id, pos, unnest(p) AS raw, generate_subscripts(p, 1) AS piece FROM cut
), s AS (
  SELECT doc_id, pos, piece, trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g')) AS sentence FROM pieces
), hits AS (
  SELECT doc_id, pos, piece, sentence_id FROM s JOIN known
  ON split_part(sentence, ' ', 1) = split_part(pattern, ' ', 1) AND regexp_full_match(sentence, pattern)
), seq AS (
  SELECT doc_id, count(*)::BIGINT AS n_sentences, string_agg(sentence_id, ',' ORDER BY pos, piece, sentence_id) AS sentence_ids
  FROM hits GROUP BY doc_id
), held AS (
  SELECT DISTINCT doc_id, license, ids FROM seq, rules WHERE contains(',' || sentence_ids || ',', ids)
), longest AS (
  SELECT doc_id, license FROM held a
  WHERE NOT EXISTS (SELECT 1 FROM held b WHERE b.doc_id IS NOT DISTINCT FROM a.doc_id AND b.ids <> a.ids AND contains(b.ids, a.ids))
)
SELECT doc_id, n_sentences, sentence_ids, coalesce(l.licenses, '') AS licenses
FROM seq LEFT JOIN (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM longest GROUP BY doc_id) l USING (doc_id)
"""


OP10 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS d FROM pages
), q AS (
  SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) END AS first_id FROM p
)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM q
"""


#: The cheapest edits row by row: a row of ``path`` is the best way to a state
#: (E nothing yet, S, U, A by the last role) with its edits and output lines.
OP12 = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
         lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
  FROM conversations
), drawn AS (
  SELECT given.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: ord(x)::BIGINT)),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS d
  FROM given, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy
  FROM drawn WHERE d <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged
), bare AS (
  SELECT *, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS b, left(role, 1) AS r,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed
), told AS (
  SELECT *, b = '' AS blank, b <> '' AND again AS dup, b <> '' AND NOT again AND right(b, 1) NOT IN ('.', '!', '?') AS cut FROM bare
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated,
         count(*) FILTER (i > 1 AND before || r NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM told GROUP BY conv_id
), inserts(q, w, ins, made) AS (
  VALUES ('E', 'E', '', []::VARCHAR[]), ('E', 'U', 'I', ['user:']), ('E', 'A', 'II', ['user:', 'assistant:']),
         ('S', 'S', '', []), ('S', 'U', 'I', ['user:']), ('S', 'A', 'II', ['user:', 'assistant:']),
         ('U', 'U', '', []), ('U', 'A', 'I', ['assistant:']), ('A', 'A', '', []), ('A', 'U', 'I', ['user:'])
), acts(w, act, v, price) AS (
  VALUES ('E', 'D', 'E', 2), ('S', 'D', 'S', 2), ('U', 'D', 'U', 2), ('A', 'D', 'A', 2),
         ('E', 'R', 'U', 1), ('S', 'R', 'U', 1), ('U', 'R', 'A', 1), ('A', 'R', 'U', 1),
         ('E', 'K', 'S', 0), ('E', 'K', 'U', 0), ('S', 'K', 'U', 0), ('U', 'K', 'A', 0), ('A', 'K', 'U', 0)
), path(conv_id, i, q, cost, audit, lines) AS (
  SELECT conv_id, 0::BIGINT, 'E', 0::BIGINT, '', []::VARCHAR[] FROM counted
  UNION ALL
  SELECT conv_id, i, v, cost, audit, lines FROM (
    SELECT p.conv_id, t.i, a.v, p.cost + 5 * length(n.ins) + a.price + CASE WHEN t.cut AND a.act <> 'D' THEN 5 ELSE 0 END AS cost,
           p.audit || n.ins || a.act AS audit,
           list_concat(p.lines, n.made, CASE a.act WHEN 'D' THEN [] WHEN 'K' THEN [t.role || ':' || t.text]
                       ELSE [CASE a.v WHEN 'U' THEN 'user:' ELSE 'assistant:' END || t.text] END) AS lines
    FROM path p JOIN told t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.i = p.i + 1
    JOIN inserts n ON n.q = p.q JOIN acts a ON a.w = n.w
    WHERE (a.act = 'D' OR NOT (t.blank OR t.dup)) AND (a.act <> 'K' OR t.r = lower(a.v))
  ) QUALIFY row_number() OVER (PARTITION BY conv_id, v ORDER BY cost, audit) = 1
), ended AS (
  SELECT p.conv_id, p.cost + 5 * length(e.ins) AS cost, p.audit || e.ins AS audit, list_concat(p.lines, e.made) AS lines
  FROM path p JOIN counted c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.n = p.i
  JOIN (VALUES ('E', '', []::VARCHAR[]), ('S', 'II', ['user:', 'assistant:']), ('U', 'I', ['assistant:']), ('A', '', [])) e(q, ins, made) ON e.q = p.q
  QUALIFY row_number() OVER (PARTITION BY p.conv_id ORDER BY p.cost + 5 * length(e.ins), p.audit || e.ins) = 1
)
SELECT g.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate,
       coalesce(c.truncated, 0)::BIGINT AS truncated, coalesce(c.illegal, 0)::BIGINT AS illegal, coalesce(e.cost, 0)::BIGINT AS cost,
       coalesce(e.audit, '') AS audit, sha256(coalesce(array_to_string(e.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM g.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM g.conv_id
"""

OP13 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents
), words AS (
  SELECT rid, lang, source, unnest(ws) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT rid) >= 30
), langs AS (
  SELECT lang, count(*) AS v, sum(lang_n) AS total FROM kept GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), counted AS (
  SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL
), grid AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.lang_n::HUGEINT AS lang_n
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counted c USING (lang, source, term)
), totals AS (
  SELECT lang, source, sum(n) AS total FROM grid GROUP BY ALL
), shares AS (
  SELECT g.lang, g.source, g.term, g.n, 1 + (1000000000 * (g.n + 5)) // (t.total + 5 * l.v)::HUGEINT AS p,
         1 + (1000000000 * (g.lang_n + 5)) // (l.total + 5 * l.v)::HUGEINT AS q
  FROM grid g JOIN totals t USING (lang, source) JOIN langs l USING (lang)
), pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS value FROM shares x JOIN shares y USING (lang, term) GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.other = b.source
), term AS (
  SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shares WHERE n > 0 AND p > q
), both_parts AS (
  SELECT * FROM pair UNION ALL SELECT * FROM term
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_parts
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
