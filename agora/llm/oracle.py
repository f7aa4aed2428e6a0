"""DuckDB SQL over the same tables, for the queries whose result SQL can express."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# a window is looked up among all word sequences of its length in the documents
OP2 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(LOWERED, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT row_number() OVER () AS iid, item_id, regexp_extract_all(LOWERED, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT iid, item_id, size, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM (SELECT *, least(len(w), 10) AS size FROM items WHERE len(w) > 0))),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM docs),
grams AS (
  SELECT rid, i, size, array_to_string(w[i:i + size - 1], ' ') AS gram FROM places, sizes WHERE i + size - 1 <= len(w)),
found AS (SELECT g.rid, g.i, g.size, v.item_id FROM grams g JOIN windows v ON g.size = v.size AND g.gram = v.gram),
hits AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT rid, i, size FROM found)) GROUP BY rid),
named AS (
  SELECT rid, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS name FROM found WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(m.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(m.names, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hits h ON d.rid = h.rid LEFT JOIN named m ON d.rid = m.rid
""".replace("LOWERED", _LOWER.format("coalesce(text, '')"))

OP6 = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT rid, doc_id, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS i FROM docs),
keyed AS (
  SELECT *, LOWERED AS k FROM lines),
often AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT a.*, o.k IS NOT NULL AND a.doc_id <> o.keeper AS gone FROM keyed a LEFT JOIN often o ON a.k = o.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid, doc_id
""".replace("LOWERED", _LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"))

OP11 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]'), lambda w: w <> '') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM starts, (VALUES (1), (2), (3), (4)) AS lengths(k) WHERE i + k - 1 <= len(w) GROUP BY 1, 2, 3),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE k = 1 GROUP BY lang),
often AS (SELECT *, string_split(phrase, ' ') AS w FROM grams WHERE k > 1 AND f >= 30),
inner_parts AS (
  SELECT o.lang, array_to_string(o.w[i:i + m - 1], ' ') AS phrase, max(o.f) AS longer
  FROM (SELECT *, unnest(range(2, k)) AS m FROM often) o, range(1, 5) AS r(i) WHERE i + m - 1 <= o.k GROUP BY 1, 2),
candidates AS (
  SELECT o.lang, o.phrase, o.k, o.w, o.f AS a FROM often o LEFT JOIN inner_parts p ON o.lang = p.lang AND o.phrase = p.phrase
  WHERE p.longer IS NULL OR 100 * p.longer < 80 * o.f),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM candidates),
sides AS (
  SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, CAST((CAST(2000000 AS HUGEINT) * c.a) // (x.f + y.f) AS BIGINT) AS score
  FROM cuts c JOIN grams x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN grams y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:], ' ')),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS pick FROM sides),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest WHERE pick = 1)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN totals t ON r.lang = t.lang WHERE r.rank <= 2000
"""

OP12 = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
numbers AS (
  SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS c1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS c2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS p, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS q
  FROM drawn),
formed AS (
  SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR p >= 90 THEN 'plain'
              WHEN q < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers),
pieces AS (
  SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM formed)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM pieces
"""

# base32 of the 160 bits of a SHA-1: four times 40 bits, eight letters of 5 bits each
OP13 = r"""
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY body) AS first FROM payloads)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
         (CAST('0x' || substr(h, CAST(1 + 10 * (i // 8) AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31 AS BIGINT) + 1, 1)),
         'string_agg', '') AS payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id OR page_id IS NULL THEN first END AS refers_to
FROM firsts
"""

ORACLE_SQL: dict[str, str] = {"op2_decontaminate": OP2, "op6_line_dedup": OP6, "op11_phrases": OP11, "op12_fim": OP12, "op13_warc": OP13}
