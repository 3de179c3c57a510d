"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

from .quality_rules import RULES

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_BITS = " + ".join(f"CASE WHEN {condition} THEN {1 << i} ELSE 0 END" for i, condition in enumerate(RULES.values()))

OP4 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM d),
gram AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM win),
hit AS (SELECT r, count(DISTINCT i + o) AS n FROM gram, (VALUES (0), (1), (2)) AS s(o) WHERE n > 1 GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(l) AS BIGINT) AS n_lines,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(hit.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS BIGINT) AS n_letter_words
  FROM d LEFT JOIN hit USING (r)),
b AS (SELECT *, CAST({_BITS} AS BIGINT) AS fail_bits FROM m)
SELECT *, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept FROM b
"""

_RULES = ", ".join(f"('{rule}', {1 << i})" for i, rule in enumerate(RULES))

ABLATIONS = OP4[: OP4.rindex("SELECT *, (fail_bits")] + f"""
SELECT rule, CAST(count(*) FILTER ((fail_bits & bit) <> 0) AS BIGINT) AS n_failed, CAST(count(*) FILTER (fail_bits = bit) AS BIGINT) AS n_only
FROM b, (VALUES {_RULES}) AS r(rule, bit) GROUP BY rule
"""

OP6 = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, p, sha256(array_to_string(w[p : p + 19], ' ')) AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d)),
late AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, p + o AS p FROM late, range(0, 20) AS s(o)),
kept AS (SELECT d.doc_id, string_agg(x.word, ' ' ORDER BY x.p) FILTER (gone.p IS NULL) AS t, count(gone.p) AS n_removed
         FROM d, LATERAL (SELECT unnest(d.w) AS word, unnest(range(1, len(d.w) + 1)) AS p) AS x
         LEFT JOIN gone ON gone.doc_id = d.doc_id AND gone.p = x.p GROUP BY d.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

#: Distinct shingles of three words, links by the sizes of their intersections, and everything a document reaches.
OP7 = rf"""
WITH RECURSIVE t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
d AS (SELECT doc_id, {WORDS} AS w FROM t),
g AS (SELECT doc_id, md5(array_to_string(w[p : p + 2], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS p FROM d WHERE len(w) > 0) GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM g a JOIN g b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM pair JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * m >= 90 * (a.n + b.n - m)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x)
SELECT documents.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = documents.doc_id
"""

#: Bytes as pairs of hexadecimal digits; a window is 400 of these.  Texts are read in blocks of 1,000 windows, as a far place in a long string is slow to find.
OP8 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS t FROM documents),
blk AS (SELECT doc_id, b, substring(t, 2000 * b + 1, 2398) AS u FROM (SELECT doc_id, t, unnest(range(0, (len(t) // 2 - 200) // 1000 + 1)) AS b FROM d WHERE len(t) >= 400)),
win AS (SELECT doc_id, 1000 * b + q AS p, md5(substring(u, 2 * q - 1, 400)) AS g FROM (SELECT doc_id, b, u, unnest(range(1, least(1000, len(u) // 2 - 199) + 1)) AS q FROM blk)),
hit AS (SELECT doc_id, p FROM win WHERE g IN (SELECT g FROM win GROUP BY g HAVING count(*) > 1)),
step AS (SELECT doc_id, p, 1 AS s FROM hit UNION ALL SELECT doc_id, p + 200, -1 FROM hit),
edge AS (SELECT doc_id, p, sum(sum(s)) OVER (PARTITION BY doc_id ORDER BY p) AS open FROM step GROUP BY doc_id, p),
piece AS (SELECT doc_id, p AS a, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS b, open, coalesce(lag(open) OVER (PARTITION BY doc_id ORDER BY p), 0) AS before FROM edge),
gone AS (SELECT doc_id, sum(b - a) FILTER (open > 0) AS n_removed, count(*) FILTER (open > 0 AND before = 0) AS n_spans,
  list(struct_pack(a := a, b := b) ORDER BY a) FILTER (open = 0) AS gaps, min(a) AS head FROM piece GROUP BY doc_id)
SELECT d.doc_id, CAST(len(t) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
 sha256(unhex(CASE WHEN gaps IS NULL THEN t ELSE substring(t, 1, 2 * (head - 1)) || array_to_string(list_transform(gaps, lambda x: CASE WHEN x.b IS NULL THEN substring(t, 2 * x.a - 1) ELSE substring(t, 2 * x.a - 1, 2 * (x.b - x.a)) END), '') END)) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""

#: CRC-32 by its table of 256 remainders; shards by the place of a row's middle byte.
OP9 = """
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n)) AS r),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS t FROM documents),
b AS (SELECT doc_id, len(t) // 2 + 1 AS size, list_transform(regexp_extract_all(t, '..'), lambda x: (instr('0123456789ABCDEF', x[1]) - 1) * 16 + instr('0123456789ABCDEF', x[2]) - 1) AS bytes FROM d),
c AS (SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(xor(4294967295, list_reduce(bytes, lambda c, x: xor(r[(xor(c, x) & 255) + 1], c >> 8), 4294967295::BIGINT)) AS BIGINT) AS text_crc32 FROM b, crc),
s AS (SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size) AS upto, sum(size) OVER () AS total FROM c),
p AS (SELECT *, CAST(least((2 * upto - size) * 16 // (2 * total), 15) AS INTEGER) AS shard FROM s)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p
"""

ORACLES = {"op4_quality_rules": OP4, "quality_ablations": ABLATIONS, "op6_substring_dedup": OP6, "op7_jaccard_join": OP7, "op8_suffix_dedup": OP8, "op9_sharding": OP9}
