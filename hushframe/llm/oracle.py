"""SQL for the queries of this subpackage, where SQL can express them."""

from __future__ import annotations

_SQL: dict[str, str] = {}


#: The table of CRC-32, and the CRC-32 of the UTF-8 bytes of a text ``f`` by it.
_CRC_TABLE = """bits(i, k, v) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END
  FROM bits WHERE k < 8
), crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8)"""
_CRC = """xor(list_reduce(list_prepend(4294967295,
  list_transform(range(1, octet_length(encode(f)) + 1), lambda i:
    CAST('0x' || substr(hex(encode(f)), CAST(2 * i - 1 AS INT), 2) AS BIGINT))),
  lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS INT)])), 4294967295)"""
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


_SQL["op7_exact_dedup"] = r"""
WITH normal AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), ranked AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id,
         row_number() OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS n,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM normal
)
SELECT doc_id, keep_id, group_size, n = 1 AS kept, sha256(norm) AS text_sha256 FROM ranked
"""

_SQL["op8_mix"] = r"""
WITH sizes AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM sizes GROUP BY source
), levels AS (
  SELECT *,
         sum(s) OVER () - 3 * coalesce(sum(s) OVER o, 0) AS rest,
         sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS w_rest
  FROM sources
  WINDOW o AS (ORDER BY s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), free AS (
  SELECT *, CAST(w AS DOUBLE) * CAST(rest AS DOUBLE)
            <= 3 * CAST(s AS DOUBLE) * CAST(w_rest AS DOUBLE) AS is_free
  FROM levels
), level AS (
  SELECT rest, w_rest FROM free WHERE is_free ORDER BY w_rest DESC LIMIT 1
), targets AS (
  SELECT source, s AS source_size,
         CASE WHEN is_free THEN least(
                CAST(w AS DOUBLE) * CAST((SELECT rest FROM level) AS DOUBLE)
                / CAST((SELECT w_rest FROM level) AS DOUBLE), 3 * CAST(s AS DOUBLE))
              ELSE 3 * CAST(s AS DOUBLE) END AS target
  FROM free
), rates AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         CAST(CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)
              AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS draw
  FROM sizes JOIN targets ON sizes.source IS NOT DISTINCT FROM targets.source
), copied AS (
  SELECT *, CAST(floor(rate) AS BIGINT) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END
            AS copies
  FROM rates
)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM copied
"""

_SQL["op10_top_k"] = r"""
WITH whole AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(
    [x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
), parts AS (
  SELECT vec_id, len(v) AS dim, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM whole
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM parts q JOIN parts c ON q.i = c.i AND q.dim = c.dim
  WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
  GROUP BY q.vec_id, c.vec_id
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n
      FROM scores)
WHERE n <= 5
"""

_SQL["op11_resample"] = rf"""
WITH RECURSIVE {_CRC_TABLE}, texts AS (
  SELECT 0 AS side, doc_id, text FROM documents
  UNION ALL SELECT 1, NULL, text FROM benchmark
), words AS (
  SELECT side, doc_id, coalesce(regexp_extract_all({_LOWER.format("text")},
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM texts
), runs AS (
  SELECT side, doc_id, len(w) AS n_words, list_concat(w, list_transform(
           range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS fs FROM words
), uses AS (SELECT side, doc_id, unnest(fs) AS f FROM runs
), named AS (
  SELECT f, {_CRC} % 10000 AS bucket FROM (SELECT DISTINCT f FROM uses), crc
), counts AS (
  SELECT bucket, CAST(count(*) FILTER (side = 0) AS DOUBLE) AS s,
         CAST(count(*) FILTER (side = 1) AS DOUBLE) AS t
  FROM uses JOIN named USING (f) GROUP BY bucket
), totals AS (SELECT sum(s) + 10000 AS s, sum(t) + 10000 AS t FROM counts
), gains AS (
  SELECT bucket, floor(1000 * ln((c.t + 1) * a.s / ((c.s + 1) * a.t))) AS gain
  FROM counts c, totals a
), weights AS (
  SELECT doc_id, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight
  FROM uses JOIN named USING (f) JOIN gains USING (bucket) WHERE side = 0 GROUP BY doc_id
), draws AS (
  SELECT doc_id, n_words, CAST(len(fs) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         CAST('0x' || substr(sha256('7:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h
  FROM runs LEFT JOIN weights USING (doc_id) WHERE side = 0
), scores AS (
  SELECT doc_id, n_words >= 20 AS fit, n_features, weight,
         weight + CAST(floor(-1000 * ln(-ln((CAST(h AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT)
         AS score
  FROM draws
), places AS (
  SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS place,
         count(*) OVER (PARTITION BY fit) AS n
  FROM scores
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN fit AND place <= 25 * n // 100 THEN place END AS rank
FROM places
"""

_SQL["op12_spelling"] = rf"""
WITH RECURSIVE {_CRC_TABLE}, runs AS (
  SELECT doc_id, run, count(*) AS c FROM (
    SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[A-Za-zÀ-ÿ]+')) AS run
    FROM documents) GROUP BY doc_id, run
), hashed AS (
  SELECT run, c, {_CRC} AS h
  FROM (SELECT run, c, CAST(doc_id AS VARCHAR) || ':' || run AS f FROM runs), crc
), words AS (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (
    SELECT c, CASE WHEN h % 199 = 0
      THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2)
      ELSE run END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5
), cut AS (
  SELECT DISTINCT word, n, CAST(i AS INT) AS i,
         substr(word, 1, CAST(i AS INT) - 1) || substr(word, CAST(i AS INT) + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS near, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i
  WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS near, max(n) AS near_n
  FROM pairs GROUP BY word
), forms AS (
  SELECT word, w.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN near_n >= 5 * w.n THEN near END AS form,
         CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best USING (word)
), chain(word, last) AS (
  SELECT word, word FROM forms
  UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON c.last = f.word WHERE f.form IS NOT NULL
), ends AS (
  SELECT c.word, c.last AS root FROM chain c JOIN forms f ON c.last = f.word WHERE f.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""
