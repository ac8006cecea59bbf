"""DuckDB SQL of the contracts that SQL expresses over the given tables."""

from __future__ import annotations

_SPACES = r"[^\x20\x09-\x0D]+"

OP1 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS win, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
starts AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, i, s.n, item_id FROM starts s JOIN wins USING (win) WHERE s.n = wins.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY 1),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS joined
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)"""

OP5 = rf"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACES}') AS w FROM documents),
starts AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35)),
again AS (SELECT win FROM starts GROUP BY win HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM starts JOIN again USING (win)),
lists AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY 1),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS joined
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words) ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(joined, '')) AS kept_sha256
FROM words LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)"""

OP8 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '{_SPACES}') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
both_ AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM sets a JOIN sets b USING (s) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM both_ JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v WHERE 100 * k >= 80 * (a.n + b.n - k)),
edges AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (SELECT u AS doc_id, u AS r FROM edges UNION SELECT e.v, reach.r FROM reach JOIN edges e ON e.u = reach.doc_id WHERE reach.r < e.v),
least_ AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(least(r, doc_id), doc_id) AS component_id, coalesce(r, doc_id) >= doc_id AS kept
FROM words LEFT JOIN sizes USING (doc_id) LEFT JOIN least_ USING (doc_id)"""

OP11 = rf"""
WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_SPACES}')) AS BIGINT) AS size,
         (CAST('0x' || substr(md5(concat_ws(':', '7', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))), 1, 13) AS BIGINT)
          + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY 1),
no_ AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS no FROM sizes),
per AS (SELECT *, CAST([3, 1, 2][(no - 1) % 3 + 1] AS DOUBLE) AS w, 2 * CAST(source_size AS DOUBLE) AS cap FROM no_),
ranked AS (
  SELECT *, 1.5::DOUBLE * (SELECT sum(source_size) FROM sizes)::DOUBLE - (sum(cap) OVER o - cap) AS num,
         sum(w) OVER () - (sum(w) OVER o - w) AS den
  FROM per WINDOW o AS (ORDER BY cap / w, no ROWS UNBOUNDED PRECEDING)),
level AS (SELECT num, den FROM ranked WHERE w * num / den <= cap ORDER BY cap / w, no LIMIT 1),
goal AS (SELECT source, source_size, least(cap, w * (SELECT num FROM level) / (SELECT den FROM level)) AS target FROM per),
rows_ AS (
  SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS m
  FROM docs d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source),
parts AS (
  SELECT *, CAST(floor(m) AS BIGINT) AS whole, target - sum(CAST(floor(m) AS BIGINT) * size) OVER (PARTITION BY source)::DOUBLE AS lacking,
         (u / (1 - u)) / ((m - floor(m)) / (1 - (m - floor(m)))) AS q FROM rows_),
taken_ AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, CAST(doc_id AS VARCHAR), u ROWS UNBOUNDED PRECEDING) AS below FROM parts)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE size * (whole + CASE WHEN m > whole AND 2 * below - size <= 2 * lacking THEN 1 ELSE 0 END) END AS BIGINT) AS taken
FROM taken_"""


def _op12(rounds: int = 2) -> str:
    square = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    found = f"SELECT r, p, min({square} * 64 + e) AS de FROM parts JOIN %s USING (p) GROUP BY r, p"
    sql = """
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT r, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x FROM kept, unnest(range(16)) t(p)),
least_ AS (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 64),
b0 AS (SELECT p, e, x AS c FROM parts JOIN least_ USING (r))"""
    for k in range(rounds):
        sql += f""",
a{k} AS ({found % f'b{k}'}),
u{k} AS (SELECT p, de % 64 AS e, i, sum(x[i])::BIGINT AS s, count(*) AS n
         FROM (SELECT p, de, x, unnest(range(1, len(x) + 1)) AS i FROM a{k} JOIN parts USING (r, p)) GROUP BY 1, 2, 3),
m{k} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM u{k} GROUP BY 1, 2),
b{k + 1} AS (SELECT p, e, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m USING (p, e))"""
    return sql + f""",
last_ AS ({found % f'b{rounds}'}),
rows_ AS (SELECT r, string_agg(printf('%02x', de % 64), '' ORDER BY p) AS code, CAST(sum(de // 64) AS BIGINT) AS error FROM last_ GROUP BY 1),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN rows_ USING (r), digest"""


# CRC-32 is linear: the exclusive or of what each byte at each distance from the end gives, and of the value for zeros alone.
_CRC = """
poly AS (SELECT b, 0 AS bit, b AS x FROM range(256) t(b) UNION ALL
         SELECT b, bit + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FROM poly WHERE bit < 8),
t0 AS (SELECT b, x FROM poly WHERE bit = 8),
t AS (SELECT 0 AS k, b, x FROM t0 UNION ALL
      SELECT k + 1, t.b, xor(t.x >> 8, t0.x) FROM t JOIN t0 ON t0.b = t.x & 255 WHERE k < (SELECT max(octet_length(encode(msg))) FROM runs)),
zeros AS (SELECT 0 AS m, 4294967295 AS x UNION ALL
          SELECT m + 1, xor(zeros.x >> 8, t0.x) FROM zeros JOIN t0 ON t0.b = zeros.x & 255 WHERE m < (SELECT max(octet_length(encode(msg))) FROM runs)),
bytes AS (SELECT msg, octet_length(encode(msg)) AS m, hex(encode(msg)) AS h FROM runs GROUP BY msg),
crc AS (
  SELECT msg, xor(xor(any_value(z.x), bit_xor(t.x)), 4294967295) AS h
  FROM (SELECT msg, m, unnest(range(m)) AS j, h FROM bytes) e
  JOIN t ON t.k = m - 1 - j AND t.b = CAST('0x' || substr(e.h, 2 * j + 1, 2) AS INTEGER) JOIN zeros z ON z.m = e.m GROUP BY msg)"""

OP13 = rf"""
WITH RECURSIVE runs AS (
  SELECT r, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r AS msg FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS r
    FROM documents)),{_CRC},
words AS (
  SELECT word, count(*) AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word FROM runs JOIN crc USING (msg))
  GROUP BY 1 HAVING length(word) >= 5 AND count(*) >= 3),
cut AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
one AS (
  SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT word, rest FROM cut SEMI JOIN words w ON cut.rest = w.word
  UNION SELECT rest, word FROM cut SEMI JOIN words w ON cut.rest = w.word),
pairs AS (SELECT a.word, a.n, one.near, b.n AS near_n FROM one JOIN words a ON a.word = one.word JOIN words b ON b.word = one.near),
best AS (SELECT word, n, count(*) AS n_near, min(struct_pack(m := -near_n, w := near)) AS b FROM pairs GROUP BY 1, 2),
forms AS (SELECT word, n_near, CASE WHEN -b.m >= 2 * n THEN b.w END AS form, CASE WHEN -b.m >= 2 * n THEN -b.m END AS form_n FROM best),
chain AS (SELECT word, word AS last_, 0 AS step FROM words UNION ALL
          SELECT chain.word, form, step + 1 FROM chain JOIN forms ON forms.word = chain.last_ WHERE form IS NOT NULL),
roots AS (SELECT word, max_by(last_, step) AS root FROM chain GROUP BY 1)
SELECT word, form, root, n, coalesce(n_near, 0) AS n_near, CAST(form_n AS BIGINT) AS form_n
FROM words LEFT JOIN forms USING (word) JOIN roots USING (word)"""

ORACLES = {"op1_decontaminate": OP1, "op5_substring_dedup": OP5, "op8_minhash_forest": OP8, "op11_mix_sources": OP11,
           "op12_vector_codes": _op12(), "op13_spelling_variants": OP13}
