"""DuckDB SQL for the queries that SQL can express over whole tables."""

OP6 = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents
), hashed AS (
  SELECT *, ('0x' || substr(md5(line), 1, 13))::BIGINT AS h FROM lines
), cuts AS (
  SELECT *, CASE WHEN xor(h, coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0) >> 1) % 4 = 0 THEN 1 ELSE 0 END AS cut FROM hashed
), placed AS (
  SELECT *, coalesce(sum(cut) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM cuts
), chunks AS (
  SELECT doc_id, k, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk FROM placed GROUP BY doc_id, k
), ranked AS (
  SELECT *, n > 1 AND row_number() OVER (PARTITION BY chunk, n > 1 ORDER BY doc_id, k) > 1 AS gone FROM chunks
)
SELECT doc_id, sum(n)::BIGINT AS n_lines, count(*)::BIGINT AS n_chunks, count(*) FILTER (gone)::BIGINT AS n_removed_chunks,
       coalesce(sum(n) FILTER (gone), 0)::BIGINT AS n_removed_lines,
       length(coalesce(string_agg(chunk, chr(10) ORDER BY k) FILTER (NOT gone), ''))::BIGINT AS kept_chars,
       md5(coalesce(string_agg(chunk, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_md5
FROM ranked GROUP BY doc_id
"""

OP7 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS own FROM words
), each AS (
  SELECT doc_id, unnest(own) AS shingle FROM sets
), shared AS (
  SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS n FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT i, j FROM shared JOIN sets x ON x.doc_id = i JOIN sets y ON y.doc_id = j WHERE 100 * n >= 90 * (len(x.own) + len(y.own) - n)
), ways AS (
  SELECT i, j FROM links UNION ALL SELECT j, i FROM links
), reached(i, j) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT r.i, w.j FROM reached r JOIN ways w ON r.j = w.i
), least AS (
  SELECT i, min(j) AS component_id FROM reached GROUP BY i
)
SELECT doc_id, len(own)::BIGINT AS n_shingles, component_id FROM sets JOIN least ON doc_id = i
"""

OP10 = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS size FROM pages
), kept AS (
  SELECT *, CASE WHEN size >= 1000 THEN max(page_id) OVER (PARTITION BY payload) ELSE page_id END AS keeper FROM payloads
)
SELECT page_id, size::BIGINT AS payload_bytes, sha1(payload) AS payload_digest, CASE WHEN keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM kept
"""



def _op13(k: int = 16, rounds: int = 3, components: int = 64) -> str:
    apart = f"list_sum(list_transform(range(1, {components + 1}), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))::BIGINT"
    parts = [f"""kept AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = {components} AND len(list_filter(embedding, lambda x: isfinite(x))) = {components}
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1 AS c, q FROM kept QUALIFY c < {k}
)"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS (
  SELECT v.row, min((d, v.c)) AS best FROM (SELECT v.row, c.c, {apart} AS d FROM kept v CROSS JOIN c{r} c) v GROUP BY v.row
)""")
        if r < rounds:
            parts.append(f"""s{r} AS (
  SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT best[2] AS c, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{r} JOIN kept USING (row)) GROUP BY c, i
), c{r + 1} AS (
  SELECT c.c, coalesce(m.q, c.q) AS q FROM c{r} c LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q FROM s{r} GROUP BY c) m USING (c)
)""")
    last = rounds
    return f"""
WITH {", ".join(parts)}, done AS (
  SELECT vec_id, best[2] AS c, best[1] AS distance FROM a{last} JOIN kept USING (row)
)
SELECT vec_id, c::INTEGER AS cluster, distance::BIGINT AS distance, (sum(distance) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(q, ',')) AS centroid_sha256
FROM done JOIN c{last} USING (c)
"""


OP13 = _op13()

ORACLE_SQL: dict[str, str] = {"op6_line_chunks": OP6, "op7_jaccard_tiles": OP7, "op10_warc_index": OP10, "op13_ball_clusters": OP13}
