"""SQL that recomputes, from the given tables alone, what the counting operators return."""

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION_SQL = rf"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), gram AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda s: array_to_string(list_slice(w, s, s + 9), ' '))) AS g
  FROM item WHERE len(w) > 0
), sized AS (
  SELECT r, w, n FROM doc, (SELECT DISTINCT n FROM gram) WHERE len(w) >= n
), part AS (
  SELECT r, n, unnest(range(1, len(w) - n + 2)) AS s, unnest(list_transform(range(1, len(w) - n + 2), lambda s: array_to_string(list_slice(w, s, s + n - 1), ' '))) AS g FROM sized
), hit AS (
  SELECT r, s, n, item FROM part JOIN gram USING (n, g)
), covered AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT r, s, n FROM hit)) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""

PHRASE_SQL = rf"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), word AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece
), total AS (
  SELECT lang, sum(len(w))::HUGEINT AS n FROM word GROUP BY lang
), gram AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda s: array_to_string(list_slice(w, s, s + k - 1), ' '))) AS phrase FROM word, range(1, 6) AS t(k) WHERE len(w) >= k
), seen AS (
  SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM gram GROUP BY ALL HAVING count(*) >= 100
), kept AS (
  SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM seen AS s WHERE k > 1
    AND NOT EXISTS (SELECT 1 FROM seen AS b WHERE b.lang = s.lang AND b.k > s.k AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * b.f >= 100 * s.f)
), cut AS (
  SELECT lang, phrase, f AS a, j, array_to_string(list_slice(w, 1, j), ' ') AS head, array_to_string(list_slice(w, j + 1, k), ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS j FROM kept)
), scored AS (
  SELECT c.lang, c.phrase, a, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n) // (x.f * y.f) AS score, j
  FROM cut AS c JOIN seen AS x ON x.lang = c.lang AND x.phrase = c.head JOIN seen AS y ON y.lang = c.lang AND y.phrase = c.tail JOIN total AS t ON t.lang = c.lang
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::INT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM best QUALIFY rank <= 2000
"""

DIVERGENCE_SQL = rf"""
WITH doc AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), term AS (
  SELECT lang, t FROM (SELECT lang, unnest(list_distinct(w)) AS t FROM doc) GROUP BY ALL HAVING count(*) >= 3
), own AS (
  SELECT DISTINCT lang, source FROM doc
), seen AS (
  SELECT lang, source, t, count(*)::HUGEINT AS c FROM (SELECT lang, source, unnest(w) AS t FROM doc) JOIN term USING (lang, t) GROUP BY ALL
), cell AS (
  SELECT o.lang, o.source, t.t, coalesce(c, 0) AS c FROM own AS o JOIN term AS t USING (lang) LEFT JOIN seen USING (lang, source, t)
), share AS (
  SELECT *, 1 + (1000000000::HUGEINT * (c + 1)) // (sum(c) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS p FROM cell
), lang_share AS (
  SELECT lang, t, 1 + (1000000000::HUGEINT * (c + 1)) // (sum(c) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q FROM (SELECT lang, t, sum(c)::HUGEINT AS c FROM cell GROUP BY ALL)
), pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item FROM own AS a JOIN own AS b ON a.lang = b.lang AND a.source <> b.source
), summed AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM share AS a JOIN share AS b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL
), valued AS (
  SELECT lang, source, part, item, coalesce(value, 0) AS value FROM pair LEFT JOIN summed USING (lang, source, item)
  UNION ALL SELECT lang, source, 'term', t, ((p - q) * (p - q)) // q FROM share JOIN lang_share USING (lang, t) WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM valued QUALIFY part = 'pair' OR rank <= 200
"""
