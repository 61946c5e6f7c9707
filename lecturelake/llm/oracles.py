"""DuckDB twins of the queries that SQL can express."""

SIZES = r"""SELECT doc_id, source, text,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents"""

OP6 = rf"""
WITH d0 AS ({SIZES}),
d AS (SELECT doc_id, source, size,
    -ln((CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, '')) || '|mix'), 1, 13)) AS BIGINT) + 0.5::DOUBLE)
        / 4503599627370496.0::DOUBLE)
    / (CAST(size + 1 AS DOUBLE) / CAST(size + 1 + length(coalesce(text, ''))
        - length(translate(coalesce(text, ''), '#*$%&|<>', '')) AS DOUBLE)) AS key
  FROM d0),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS r FROM d GROUP BY source),
s1 AS (SELECT *, CASE r % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
    source_size * 2.0::DOUBLE AS lim, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s0),
s2 AS (SELECT *,
    coalesce(sum(lim) OVER (ORDER BY lim / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS spent,
    sum(w) OVER (ORDER BY lim / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wl FROM s1),
s3 AS (SELECT *, (total - spent) * w >= lim * wl AS full_ FROM s2),
s4 AS (SELECT source, source_size, CASE WHEN full_ THEN lim ELSE
    (total - coalesce(sum(CASE WHEN full_ THEN lim END) OVER (), 0.0)) * w / sum(CASE WHEN NOT full_ THEN w END) OVER ()
    END AS target FROM s3),
e AS (SELECT d.doc_id, d.size, s4.source_size, s4.target, d.source,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id NULLS FIRST, d.size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run,
    CASE WHEN s4.source_size > 0 THEN CAST(floor(s4.target / s4.source_size) AS BIGINT) ELSE 0 END AS ep
  FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source)
SELECT doc_id, size, source_size, target, source,
  CAST(ep * size + greatest(0, least(size, CAST(round(target) AS BIGINT) - ep * source_size - run)) AS BIGINT) AS taken
FROM e
"""

OP9 = """
WITH d AS (SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS bytes,
    CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) AS h FROM documents),
n AS (SELECT dep, h >> (60 - dep) AS p, sum(bytes) AS b, count(*) AS n FROM d, range(0, 41) t(dep) GROUP BY ALL),
f AS (SELECT d.doc_id, d.h, min(dep) AS depth FROM d JOIN n ON d.h >> (60 - n.dep) = n.p
  WHERE n.b <= 1048576 OR n.n = 1 GROUP BY ALL)
, r AS (SELECT d.doc_id, d.bytes, f.depth,
  CASE WHEN f.depth = 0 THEN '-' ELSE lpad(bin(n.p), CAST(f.depth AS INTEGER), '0') END AS shard,
  CAST(n.b AS BIGINT) AS shard_bytes, n.n AS shard_docs, CAST(max(f.depth) OVER () AS BIGINT) AS global_depth
FROM d JOIN f ON d.doc_id IS NOT DISTINCT FROM f.doc_id AND d.h = f.h
JOIN n ON n.dep = f.depth AND n.p = d.h >> (60 - f.depth))
SELECT *, CASE WHEN global_depth = 0 THEN '' ELSE rpad(replace(shard, '-', ''), CAST(global_depth AS INTEGER), '0') END AS first_slot,
  CAST(1 AS BIGINT) << (global_depth - depth) AS slots FROM r
"""

OP2 = r"""
WITH k AS (SELECT page_id AS p, url, html, k, 1700000000000 + page_id * 7919 % 1000003 * 1000 AS d,
    '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag FROM pages, range(0, 3) t(k)),
r0 AS (SELECT p * 8 + k AS id, p, k, html, d,
    d + CASE WHEN k = 0 THEN 0 WHEN p % 7 = 0 THEN -3600000 ELSE k * 86400000 END AS ms,
    CASE WHEN k = 0 THEN tag WHEN p % 11 = 0 THEN NULL WHEN p % 5 = 0 THEN '"changed"' WHEN p % 5 = 1 THEN NULL
      WHEN p % 5 = 2 THEN 'W/' || tag ELSE tag END AS etag,
    CASE WHEN k > 0 AND p % 11 = 0 THEN NULL WHEN k > 0 AND p % 10 = 1 THEN 'day 0'
      ELSE 'day ' || CAST(d // 86400000 AS VARCHAR) END AS lm,
    regexp_replace(regexp_replace(trim(url), '#.*$', ''), '(?i)^[a-z][a-z0-9+.-]*://', '') AS bare FROM k),
r1 AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), ':(80|443)$', ''), '^www[0-9]*\.', '') AS host,
    regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(bare, '^[^?]*\?(.*)$', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)'))) AS q FROM r0),
r AS (SELECT *, CASE WHEN host <> '' THEN host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS cu FROM r1),
a AS (SELECT v.id, v.cu, v.etag, v.lm, v.d, v.k, max(struct_pack(ms := w.ms, id := w.id)) AS best
  FROM r v LEFT JOIN r w ON v.cu = w.cu AND w.k = 0 AND w.ms < v.ms WHERE v.k > 0 GROUP BY ALL),
b AS (SELECT a.*, w.id AS rid, w.etag AS wtag, w.lm AS wlm, w.html AS whtml, w.d AS wd FROM a LEFT JOIN r w ON a.best.id = w.id AND w.k = 0),
c AS (SELECT *, CASE WHEN rid IS NULL THEN 'no-response'
    WHEN etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = wtag THEN 'resolved' ELSE 'etag-mismatch' END
    WHEN lm IS NOT NULL THEN CASE WHEN lm = wlm THEN 'resolved' ELSE 'date-mismatch' END
    ELSE 'no-validator' END AS status FROM b)
SELECT id AS record_id, cu AS canonical_url, status,
  CASE WHEN status = 'resolved' THEN rid END AS response_id,
  CASE WHEN status = 'resolved' THEN concat_ws(chr(10), CASE WHEN k = 1 THEN 'cache-control: max-age=60' END,
    'content-length: ' || octet_length(encode(whtml)), 'content-type: text/html', 'date: ' || (d + k * 1000),
    'etag: ' || coalesce(etag, wtag), 'last-modified: ' || coalesce(lm, wlm)) END AS headers
FROM c
"""

#: crc32 of the decimal digits of conv_id, bit by bit.
CRC32 = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(0, 8)), lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END))))"""

OP11 = rf"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS o,
    struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS said FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {CRC32} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
a AS (SELECT c.conv_id, 0 AS own, o, said FROM c JOIN t ON t.conv_id = c.base AND o <= h
  UNION ALL SELECT c.conv_id, 1, o, said FROM c JOIN t ON t.conv_id = c.conv_id AND o > h),
w AS (SELECT c.conv_id, coalesce(list(said ORDER BY own, o) FILTER (said IS NOT NULL), []) AS w FROM c LEFT JOIN a ON a.conv_id = c.conv_id GROUP BY c.conv_id),
r AS (SELECT conv_id, d, w[1 : d] AS path, d = len(w) AS ends FROM w, range(0, 100000) t(d) WHERE d <= len(w)),
n AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS ids,
    (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(path[d].text, '[^\x20\x09-\x0D]+')) END AS saved FROM r GROUP BY path, d),
k AS (SELECT path[1 : d - 1] AS path, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON n.path = k.path AND n.d = k.d),
u AS (SELECT path[1 : e] AS path, e AS d, sum(CAST(n_children = 0 AS BIGINT)) AS n_leaves, sum(saved) AS saved FROM f, range(0, 100000) t(e) WHERE e <= d GROUP BY ALL)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(u.n_leaves AS BIGINT) AS n_leaves,
  CAST(u.saved AS BIGINT) AS saved_tokens, sha256(f.ids) AS ends_sha256
FROM f JOIN u ON f.path = u.path AND f.d = u.d LEFT JOIN f p ON p.path = f.path[1 : f.d - 1] AND p.d = f.d - 1
"""

OP12 = r"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i : i + 4], ' ') AS g FROM d, range(1, 100000) t(i)
  WHERE len(w) > 0 AND i <= greatest(1, len(w) - 4)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS both_ FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
e AS (SELECT p.x, p.y FROM p JOIN n a ON a.r = p.x JOIN n b ON b.r = p.y WHERE 100 * both_ >= 85 * (a.n + b.n - both_)),
c(r, top) AS (SELECT r, r FROM d UNION SELECT e.y, c.top FROM c JOIN e ON e.x = c.r),
m AS (SELECT c.r, min(d.doc_id) AS component_id FROM c JOIN d ON d.r = c.top GROUP BY c.r)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id IS NOT DISTINCT FROM m.component_id AS kept
FROM d LEFT JOIN n ON n.r = d.r JOIN m ON m.r = d.r
"""

OP13_ROUND = """
a{i} AS MATERIALIZED (SELECT z.r, z.p, min(struct_pack(d := list_sum(list_transform(range(1, len(z.x) + 1), lambda j: (z.x[j] - c.c[j]) * (z.x[j] - c.c[j]))), e := c.e)) AS b
  FROM z JOIN c{i} c ON z.p = c.p GROUP BY z.r, z.p),
s{i} AS (SELECT z.p, a.b.e AS e, j, sum(z.x[j]) AS s, count(*) AS n FROM z JOIN a{i} a ON z.r = a.r AND z.p = a.p, range(1, 1000) t(j)
  WHERE j <= len(z.x) GROUP BY ALL),
c{k} AS MATERIALIZED (SELECT c.p, c.e, coalesce(n.c, c.c) AS c FROM c{i} c LEFT JOIN
  (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c FROM s{i} GROUP BY ALL) n ON c.p = n.p AND c.e = n.e),"""

OP13 = f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
z AS MATERIALIZED (SELECT r, p, v[p * len(v) // 8 + 1 : (p + 1) * len(v) // 8] AS x FROM k, range(0, 8) t(p)),
c0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM z WHERE r <= 16),
{"".join(OP13_ROUND.format(i=i, k=i + 1) for i in range(7))}
f AS (SELECT r, string_agg(printf('%02x', b.e), '' ORDER BY p) AS code, CAST(sum(b.d) AS BIGINT) AS error FROM a6 GROUP BY r),
l AS (SELECT k.vec_id, f.code, f.error, k.label FROM k JOIN f ON k.r = f.r),
h AS (SELECT sha256(string_agg(CAST(c[j] AS VARCHAR), ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM c6, range(1, 1000) t(j) WHERE j <= len(c))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM l, h
"""

ORACLES = {"op2_revisits": OP2, "op6_source_mix": OP6, "op9_hash_shards": OP9, "op11_prefix_trie": OP11, "op12_minhash": OP12, "op13_vector_codes": OP13}
