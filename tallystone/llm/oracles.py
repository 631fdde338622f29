"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = f"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') FROM benchmark
), item_windows AS (
  SELECT DISTINCT CAST(id AS VARCHAR) AS item, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM words WHERE kind = 'i' AND len(w) > 0)
), lengths AS (
  SELECT DISTINCT n FROM item_windows
), doc_windows AS (
  SELECT id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, lengths WHERE kind = 'd' AND len(w) >= n)
), matches AS (
  SELECT id, item, i, n FROM doc_windows JOIN item_windows USING (n, g)
), hits AS (
  SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT id, i, n FROM matches)) GROUP BY id
), found AS (
  SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, item FROM matches) GROUP BY id
)
SELECT words.id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hits ON words.id = hits.id LEFT JOIN found ON words.id = found.id WHERE kind = 'd'
"""

OP7 = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT doc_id, pos, line, repeated.key IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN repeated ON keyed.key = repeated.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP12 = f"""
WITH RECURSIVE digits AS (
  SELECT n, n AS crc, 0 AS step FROM range(256) AS t(n)
  UNION ALL
  SELECT n, CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END, step + 1 FROM digits WHERE step < 8
), crcs AS MATERIALIZED (
  SELECT list(crc ORDER BY n) AS crc_of FROM digits WHERE step = 8
), words AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') FROM benchmark
), features AS (
  SELECT kind, id, f, count(*) AS n FROM (
    SELECT kind, id, unnest(w) AS f FROM words
    UNION ALL
    SELECT kind, id, w[i] || ' ' || w[i + 1] FROM (SELECT kind, id, w, unnest(range(1, len(w))) AS i FROM words)
  ) GROUP BY ALL
), hashed AS (
  SELECT f, xor(list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, octet_length(encode(f))), lambda i: CAST('0x' || substr(hex(encode(f)), 2 * i + 1, 2) AS BIGINT))),
    lambda crc, b: xor(crc >> 8, CAST(crc_of[(xor(crc, b) & 255) + 1] AS BIGINT))), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM features), crcs
), counts AS (
  SELECT bucket, coalesce(sum(n) FILTER (WHERE kind = 'd'), 0) AS s, coalesce(sum(n) FILTER (WHERE kind = 'b'), 0) AS t FROM features JOIN hashed USING (f) GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS BIGINT) AS gain FROM counts
), weights AS (
  SELECT id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS total FROM features JOIN hashed USING (f) JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY id
), scored AS (
  SELECT words.id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features,
    coalesce(total // n_features - CASE WHEN total % n_features < 0 THEN 1 ELSE 0 END, 0) AS weight,
    CAST('0x' || substr(sha256('7:' || words.id), 1, 8) AS BIGINT) AS h
  FROM words LEFT JOIN weights ON words.id = weights.id WHERE kind = 'd'
), drawn AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM scored
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS eligible FROM drawn
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * eligible // 100 THEN place END AS rank FROM ranked
"""

OP13 = """
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS x FROM documents
), draws AS (
  SELECT *, CAST('0x' || substr(x, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(x, 9, 8) AS BIGINT) % (n + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(x, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
      WHEN CAST('0x' || substr(x, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM hashed
), parts AS (
  SELECT *, left(text, least(a, b)) AS prefix, substring(text, least(a, b) + 1, greatest(a, b) - least(a, b)) AS middle, substring(text, greatest(a, b) + 1) AS suffix FROM draws
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""

ORACLES: dict[str, str] = {"op1_decontaminate": OP1, "op7_line_dedup": OP7, "op12_resample": OP12, "op13_fill_in_middle": OP13}
