"""Check SQL of the registered queries, for DuckDB.

The other operators are beyond SQL and are tested against brute force.
"""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS shingle FROM d, unnest(range(1, greatest(len(w) - 1, 2))) t(i)
  WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles,
  least(doc_id, coalesce((SELECT min(b) FROM reach WHERE a = d.doc_id), doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id)"""

OP5 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (
  SELECT doc_id, i, w[i] AS word, CASE WHEN i + 49 <= len(w) THEN md5(array_to_string(w[i:i + 49], ' ')) END AS s
  FROM d, unnest(range(1, len(w) + 1)) t(i)),
f AS (SELECT s, min(doc_id) AS earliest FROM p WHERE s IS NOT NULL GROUP BY s),
l AS (SELECT p.doc_id, i, word, coalesce(earliest < p.doc_id, FALSE) AS late FROM p LEFT JOIN f USING (s)),
g AS (
  SELECT doc_id, i, word, coalesce(i - max(CASE WHEN late THEN i END) OVER o < 50, FALSE) AS gone FROM l
  WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
r AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept
  FROM g GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)"""

OP11 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner,
    coalesce(source, '') || chr(31) || coalesce(lang, '') AS repository FROM documents),
p(kind, pattern) AS (VALUES
  (0, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  (1, 'AKIA[A-Z0-9]+'), (2, '[0-9a-f]{24,}'), (3, '[A-Za-z0-9+/_=-]{20,}')),
t AS (
  SELECT doc_id, owner, repository, kind, regexp_extract_all(text, pattern) AS found,
    CASE WHEN kind = 0 THEN regexp_extract_all(text, pattern, 2) ELSE regexp_extract_all(text, pattern) END AS v,
    string_split_regex(text, pattern) AS between FROM d, p),
u AS (
  SELECT *, i, found[i] AS whole, v[i] AS value,
    list_sum(list_transform(between[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[:i - 1], lambda x: length(x))), 0) AS start
  FROM t, unnest(range(1, len(found) + 1)) r(i)),
m AS (
  SELECT doc_id, owner, repository, kind, value, start::BIGINT AS start, (start + length(whole))::BIGINT AS stop,
    length(value) >= 20 AND len(list_distinct(string_split(value, ''))) >= 12 AND regexp_matches(value, '[0-9]')
      AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AS looks
  FROM u WHERE length(value) >= [6, 20, 24, 20][kind + 1]),
c AS (
  SELECT * FROM m WHERE kind < 3 OR (looks AND NOT EXISTS (
    SELECT 1 FROM m b WHERE b.doc_id = m.doc_id AND b.kind < 3 AND b.start < m.stop AND m.start < b.stop))),
o AS (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT repository) AS repositories FROM c GROUP BY value),
j AS (
  SELECT c.*, ['assign', 'access', 'hex', 'live'][kind + 1] || ':' || start || ':' || stop AS name,
    CASE WHEN owners >= 3 OR repositories >= 5 THEN 'copied' WHEN looks AND owners = 1 THEN 'live' ELSE 'found' END AS verdict
  FROM c JOIN o USING (value)),
k AS (SELECT * FROM j WHERE kind < 3 OR verdict = 'live')
SELECT d.doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access,
  count(*) FILTER (WHERE kind = 2) AS n_hex,
  sha256(coalesce(string_agg(name, ',' ORDER BY start, kind) FILTER (WHERE kind < 3), '')) AS base_sha256,
  coalesce(string_agg(name, ',' ORDER BY start, kind), '') AS spans,
  count(*) FILTER (WHERE verdict = 'live') AS n_live, count(*) FILTER (WHERE verdict = 'copied') AS n_copied
FROM d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id"""

OP12 = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT doc, lang, source, term FROM d, unnest(w) u(term)),
v AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
n AS (SELECT lang, count(*) AS v FROM v GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (
  SELECT g.lang, g.source, v.term, coalesce(k.n, 0) AS n FROM g JOIN v USING (lang)
  LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL) k
    ON k.lang = g.lang AND k.source = g.source AND k.term = v.term),
p AS (
  SELECT lang, source, term, n,
    1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * n.v) AS p
  FROM c JOIN n USING (lang)),
l AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term),
q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * n.v) AS q
  FROM (SELECT * FROM l) l JOIN n USING (lang)),
a AS (
  SELECT x.lang, x.source, y.source AS item, coalesce(sum(abs(m.p - o.p)), 0) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN p m ON m.lang = x.lang AND m.source = x.source
  LEFT JOIN p o ON o.lang = y.lang AND o.source = y.source AND o.term = m.term
  GROUP BY x.lang, x.source, y.source),
b AS (SELECT p.lang, p.source, p.term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (
  SELECT lang, source, 'pair' AS part, item, value FROM a UNION ALL SELECT lang, source, 'term', item, value FROM b)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
WHERE part = 'pair' OR rank <= 50"""

OP13 = r"""
WITH r AS (
  SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
  (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5"""

CHECK_SQL: dict[str, str] = {
    "op2_ngram_join": OP2,
    "op5_recompression_dedup": OP5,
    "op11_secret_scan": OP11,
    "op12_source_divergence": OP12,
    "op13_hard_negatives": OP13,
}
