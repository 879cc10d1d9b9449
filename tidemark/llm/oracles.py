"""DuckDB SQL for the queries that SQL can express."""

WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP2 = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS s
        FROM b, range(1, greatest(len(w) - 9, 1) + 1) r(i) WHERE len(w) > 0),
pos AS (SELECT doc_id, w, i FROM d, range(1, len(w) + 1) r(i)),
hit AS (SELECT p.doc_id, p.i, win.m, win.item_id
        FROM (SELECT doc_id, i, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS s
              FROM pos, (SELECT DISTINCT m FROM win) WHERE i + m - 1 <= len(w)) p JOIN win USING (m, s)),
n AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hit, range(0, 10) r(j) WHERE j < m GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""

#: Matches m and the pieces between them give each match its start.
OP3_RULES = (
    ("assign", r"""(?i:(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?)[A-Za-z0-9+/_.=-]+""", r"""length(regexp_extract(x, '(?i:(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?)([A-Za-z0-9+/_.=-]+)', 1)) >= 6"""),
    ("access", "AKIA[A-Z0-9]+", "length(x) >= 20"),
    ("hex", "[0-9a-f]+", "length(x) >= 24"),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "true"),
)
OP3_SPANS = " UNION ALL ".join(
    f"""SELECT doc_id, {k} AS k, '{kind}' AS kind, s, s + length(x) AS e FROM (
        SELECT doc_id, ms[i] AS x, list_sum(list_transform(ps[:i], lambda p: length(p))) + coalesce(list_sum(list_transform(ms[:i - 1], lambda m: length(m))), 0) AS s
        FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS ms, regexp_split_to_array(t, '{p}') AS ps FROM d), range(1, len(ms) + 1) r(i)) WHERE {keep}"""
    for k, (kind, p, keep) in enumerate(OP3_RULES)
)
OP3 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), spans AS ({OP3_SPANS}),
one AS (SELECT doc_id, s, k, kind || ':' || s::BIGINT || ':' || e::BIGINT AS span FROM spans),
a AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
      string_agg(span, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(span, ',' ORDER BY s, k) AS spans FROM one GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)
"""

OP9 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM t
"""

OP10 = r"""
WITH l AS (SELECT doc_id, (i - 1)::INTEGER AS line, regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+') AS w
           FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), range(1, len(ls) + 1) r(i)),
f AS (SELECT w, array_to_string(w, ' ') AS s, min(doc_id * 10000000 + line) AS o FROM l WHERE len(w) > 0 GROUP BY w),
v AS (SELECT s, o, p, len(w) AS n, array_to_string(list_concat(w[:p - 1], w[p + 1:]), ' ') AS v FROM f, range(1, len(w) + 1) r(p) WHERE len(w) >= 5),
gone AS (SELECT b.s FROM v a JOIN v b ON a.v = b.v AND a.p = b.p AND a.n = b.n WHERE a.o < b.o
         UNION SELECT CASE WHEN v.o < f.o THEN f.s ELSE v.s END FROM v JOIN f ON v.v = f.s AND len(f.w) >= 5),
stay AS (SELECT o FROM f WHERE s NOT IN (SELECT s FROM gone)),
k AS (SELECT doc_id, count(*) AS n_lines, list(line ORDER BY line) FILTER (len(w) = 0 OR doc_id * 10000000 + line IN (SELECT o FROM stay)) AS kept FROM l GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(len(kept), 0)::BIGINT AS n_kept, coalesce(array_to_string(kept, ','), '') AS kept
FROM documents LEFT JOIN k USING (doc_id)
"""

#: Rows are kept if no component is missing; parts as lists of whole numbers, which doubles hold exactly.
OP11_ROWS = """kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, label, p, q[p * 16 + 1:p * 16 + 16] AS x FROM kept, range(0, 4) r(p)),
e0 AS MATERIALIZED (SELECT p, e, x FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < 256)"""


def op11() -> str:
    """Four rounds written out, each an assignment and the means."""
    d = "list_inner_product(a.x, a.x) + list_inner_product(b.x, b.x) - 2 * list_inner_product(a.x, b.x)"
    near = lambda r: f"n{r} AS MATERIALIZED (SELECT vec_id, label, a.p, any_value(a.x) AS x, arg_min(b.e, ({d}, b.e)) AS e, min({d}) AS d FROM parts a JOIN e{r} b ON a.p = b.p GROUP BY vec_id, label, a.p)"
    means = lambda r: f"""m{r} AS (SELECT p, e, list(floor(v / n) ORDER BY i) AS x FROM (SELECT p, e, i, sum(x[i]) AS v, count(*) AS n FROM n{r}, range(1, 17) t(i) GROUP BY ALL) GROUP BY p, e),
e{r + 1} AS MATERIALIZED (SELECT o.p, o.e, coalesce(m{r}.x, o.x) AS x FROM e{r} o LEFT JOIN m{r} ON o.p = m{r}.p AND o.e = m{r}.e)"""  # noqa: E731
    rounds = ", ".join(f"{near(r)}, {means(r)}" for r in range(4))
    return f"""WITH {OP11_ROWS}, {rounds}, {near(4)},
codes AS (SELECT vec_id, label, string_agg(printf('%02x', e::INT), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM n4 GROUP BY vec_id, label),
books AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda v: v::BIGINT), ','), ',' ORDER BY p, e)) AS h FROM e4)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT h FROM books) AS codebooks_sha256 FROM codes"""


#: Distinct sets meet if their sizes allow the similarity; components by repeated steps to smaller ids.
OP12 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS s FROM w),
c AS MATERIALIZED (SELECT s, len(s) AS n, min(doc_id) AS id FROM s WHERE len(s) > 0 GROUP BY s),
l AS MATERIALIZED (SELECT a, b FROM (SELECT a.id AS a, b.id AS b, a.n + b.n AS total, len(list_intersect(a.s, b.s)) AS common FROM c a JOIN c b ON a.id < b.id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n) WHERE 100 * common >= 80 * (total - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT id AS a, id AS r FROM c UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.a WHERE reach.r < e.b),
root AS (SELECT a, min(r) AS r FROM reach GROUP BY a)
SELECT doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(r, doc_id) AS component_id, coalesce(r, doc_id) = doc_id AS kept
FROM s LEFT JOIN c ON s.s = c.s LEFT JOIN root ON root.a = c.id
"""

OP13 = """
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

ORACLES = {"op2_decontaminate": OP2, "op3_secret_ledger": OP3, "op9_warc": OP9, "op10_line_dedup": OP10, "op11_vector_codes": op11(), "op12_minmax": OP12, "op13_hard_negatives": OP13}
