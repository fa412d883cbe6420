"""DuckDB SQL for the queries that SQL can express."""

EXACT_DEDUP = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g USING (t)
"""

NEAREST = """
WITH e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda x, y: x + y)) AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 10
"""

#: The conversations at hand hold plain messages only, and this says no more; calls and results are held against a brute-force version in the tests.
CHAT_FORMAT = """
SELECT conv_id, turn, turn AS order_turn, 0 AS order_slot, 0::BIGINT AS order_index, role, 'plain' AS link, 0 AS n_calls, 0 AS n_valid, NULL::VARCHAR AS call_status,
  '{' || concat_ws(',', '"content":' || to_json(text)::VARCHAR, '"role":' || to_json(role)::VARCHAR) || '}' AS message_json
FROM conversations
"""

NGRAM_JOIN = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS g FROM w
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE 10 * least(x.n, y.n) >= 9 * greatest(x.n, y.n)
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (any_value(x.n) + any_value(y.n) - count(*))
), c AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM c GROUP BY a) m ON m.a = d.doc_id
"""

MIXING = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, coalesce(source, chr(0)) AS s, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1 AS c FROM documents
), t AS MATERIALIZED (SELECT s, sum(c)::BIGINT AS t FROM d GROUP BY s),
p AS MATERIALIZED (SELECT s, t, t::DOUBLE / (SELECT sum(t) FROM t)::DOUBLE AS p FROM t),
z AS (
  SELECT 0 AS i, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
  UNION ALL
  SELECT i + 1, CASE WHEN good THEN low ELSE mid END, CASE WHEN good THEN mid ELSE high END
  FROM (SELECT i, low, high, (low + high) / 2 AS mid, (SELECT max(pow(p, (low + high) / 2 - 1)) / sum(pow(p, (low + high) / 2)) <= 2.0 + 1e-12 FROM p) AS good FROM z WHERE i < 40)
), a AS MATERIALIZED (
  SELECT CASE WHEN (SELECT max(pow(p, -1.0)) / count(*) <= 2.0 + 1e-12 FROM p) THEN 0.0 ELSE ceil(max(high) * 1e6 - 1e-3) / 1e6 END AS a FROM z WHERE i = 40
), q AS MATERIALIZED (
  SELECT s, t, pow(p, a) / (SELECT sum(pow(p, a)) FROM p, a) AS weight, pow(p, a) / (SELECT sum(pow(p, a)) FROM p, a) * (SELECT sum(t) FROM t)::DOUBLE AS quota FROM p, a
), q2 AS MATERIALIZED (SELECT *, floor(quota / t + 1e-9)::BIGINT AS whole, greatest(0, floor(quota - floor(quota / t + 1e-9) * t + 1e-6))::BIGINT AS rest FROM q),
k AS (
  SELECT doc_id, s, c, t, weight, quota, e AS epoch, whole, rest, md5('7|' || e || '|' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM (SELECT *, unnest(range(1, whole + 2)) AS e FROM d JOIN q2 USING (s))
), r AS (SELECT *, sum(c) OVER (PARTITION BY s, epoch ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM k),
f AS (SELECT *, sum(c) OVER (PARTITION BY s ORDER BY epoch, key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS stop FROM r WHERE epoch <= whole OR upto <= rest),
n AS (SELECT greatest(1, ceil(sum(quota) / 1048576 - 1e-9))::BIGINT AS n FROM q2)
SELECT doc_id, CASE WHEN s <> chr(0) THEN s END AS source, epoch, c AS n_tokens, least(n - 1, floor(stop * n / quota))::BIGINT AS block, md5('place|' || key) AS place, round(weight, 9) AS weight FROM f, n
"""


def spans(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    """Rows (row, kind, k, a, b, v) of one base kind: positions from the lengths of matches and of what stands between them."""
    return f"""SELECT row, '{kind}' AS kind, {order} AS k, a::BIGINT AS a, (a + len(m))::BIGINT AS b, v FROM (
  SELECT row, unnest(list_zip(m, v, list_transform(range(1, len(m) + 1), lambda i: coalesce(list_sum(list_transform(g[1:i], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0)))) AS z, z[1] AS m, z[2] AS v, z[3] AS a
  FROM (SELECT row, regexp_extract_all(t, {pattern}, 0) AS m, regexp_extract_all(t, {pattern}, {group}) AS v, string_split_regex(t, {pattern}) AS g FROM d)
) WHERE len(v) >= {least}"""


def either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


ASSIGN = "$$(" + either_case("password|passwd|secret|token|api_?key") + """)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)$$"""

SECRETS = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS t FROM documents),
base AS MATERIALIZED ({spans("assign", 0, ASSIGN, 2, 6)} UNION ALL {spans("access", 1, "$$AKIA[A-Z0-9]+$$", 0, 20)} UNION ALL {spans("hex", 2, "$$[0-9a-f]{24,}$$", 0, 24)}),
bare AS MATERIALIZED (
  SELECT * FROM ({spans("bare", 3, "$$[A-Za-z0-9+/_-]{16,}$$", 0, 16)}) r
  WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND NOT EXISTS (SELECT 1 FROM base WHERE base.row = r.row AND base.a < r.b AND r.a < base.b)
), found AS MATERIALIZED (SELECT * FROM base UNION ALL SELECT * FROM bare),
known AS MATERIALIZED (
  SELECT v, count(DISTINCT source) + max((source IS NULL)::INT) <= 1 AS live FROM found JOIN d USING (row) GROUP BY v HAVING min(k) < 3
), met AS MATERIALIZED (SELECT f.*, live FROM found f JOIN known USING (v) WHERE k < 3 OR live),
per AS (
  SELECT row, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER (k < 3) AS base,
    string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied, count(*) FILTER (k = 3) AS n_added
  FROM met GROUP BY row
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(n_added, 0) AS n_added
FROM d LEFT JOIN per USING (row)
"""


def centroids(rounds: int = 10, k: int = 8) -> str:
    """Lloyd's rounds one after another, over whole numbers."""
    nearest = lambda c: f"SELECT v.row, arg_min(c.c, (list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, c.c)) AS c FROM v, {c} c GROUP BY v.row"
    parts = [
        """v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1)::INT AS c, v FROM v QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id), v) <= {k})",
    ]
    for r in range(rounds):
        parts.append(f"a{r} AS MATERIALIZED ({nearest(f'c{r}')})")
        parts.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT o.c, coalesce(n.v, o.v) AS v FROM c{r} o LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS v
    FROM (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS i FROM a{r} JOIN v USING (row)) GROUP BY c, i) GROUP BY c
  ) n USING (c)
)""")
    last = f"c{rounds}"
    parts.append(f"f AS MATERIALIZED ({nearest(last)})")
    return "WITH " + ", ".join(parts) + f"""
, d AS (SELECT vec_id, c AS cluster, list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM f JOIN v USING (row) JOIN {last} c USING (c))
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, centroid_sha256 FROM d
"""


FILTER_AUDIT = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS MATERIALIZED (
  SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)::INT AS mask FROM d
), l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
n AS MATERIALIZED (SELECT part, mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
  FROM f a JOIN f b ON b.b <> a.b JOIN f c ON c.b NOT IN (a.b, b.b) JOIN f d ON d.b NOT IN (a.b, b.b, c.b) JOIN f e ON e.b NOT IN (a.b, b.b, c.b, d.b)
), s AS (SELECT filter_order, i::INT AS step, bits[i] AS own, coalesce(list_sum(bits[1:i - 1]), 0)::INT AS earlier FROM o, range(1, 6) r(i)),
r AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (mask & (own | earlier) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & own > 0 AND mask & earlier = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & own > 0 AND mask & earlier > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (mask & own > 0 AND mask & earlier = 0 AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (mask & own > 0 AND mask & earlier = 0 AND toxic), 0)::BIGINT AS toxic_lost
  FROM n, s GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM r
"""
