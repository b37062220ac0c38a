"""DuckDB SQL for the engine's queries: the same results from the same tables."""

from __future__ import annotations

from .queries import LEFT

EMB = """cells AS (
  SELECT vec_id AS sample_id, (i - 1)::INTEGER AS locus,
         CASE WHEN x < -0.1::DOUBLE THEN 0 WHEN x < 0 THEN 1 WHEN x < 0.1::DOUBLE THEN 2 WHEN x < 0.2::DOUBLE THEN 3 ELSE 4 END AS state
  FROM (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)),
samples AS (SELECT vec_id AS sample_id, (label + 1)::BIGINT AS multiplicity, 1.0::DOUBLE / (1 + vec_id % 4) AS weight FROM embeddings)"""
SEQ = """sequences AS (SELECT doc_id AS sample_id, regexp_replace(lower(text), '[^atcg]', '-', 'gs') AS sequence FROM documents)"""
DOC = SEQ + """, cells AS (
  SELECT sample_id, (i - 1)::INTEGER AS locus, (CASE c WHEN 'a' THEN 0 WHEN 't' THEN 1 WHEN 'c' THEN 2 WHEN 'g' THEN 3 ELSE 4 END) AS state
  FROM (SELECT sample_id, unnest(string_split(sequence, '')) AS c, generate_subscripts(string_split(sequence, ''), 1) AS i FROM sequences WHERE sequence <> ''))"""
EVT = """happened AS (
  SELECT user_id AS s, date_diff('day', TIMESTAMP '2024-01-01', ts) AS l,
         arg_max(CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END, (ts, event_id)) AS st
  FROM events GROUP BY 1, 2),
cells AS (SELECT s AS sample_id, l::INTEGER AS locus, coalesce(st, 4) AS state
  FROM (SELECT DISTINCT user_id AS s FROM events) CROSS JOIN (SELECT range AS l FROM range(0, 30)) LEFT JOIN happened USING (s, l))"""
LINE = """r AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS sample_id, * FROM lineitem),
cells AS (SELECT sample_id, l_quantity AS weight, unnest([0, 1, 2, 3, 4]) AS locus, unnest([
  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 ELSE 4 END, CASE l_linestatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 4 END,
  least(floor((l_quantity - 1) / 12.5), 3)::INTEGER, round(l_discount * 100)::INTEGER % 5, round(l_tax * 100)::INTEGER % 5]) AS state FROM r)"""
GRID = "grid AS (SELECT locus, state FROM (SELECT DISTINCT locus FROM cells) CROSS JOIN (SELECT range::INTEGER AS state FROM range(0, 5)))"
COUNTS = GRID + ", counts AS (SELECT g.locus, g.state, coalesce(n, 0)::BIGINT AS n FROM grid g LEFT JOIN (SELECT locus, state, count(*) AS n FROM cells GROUP BY 1, 2) USING (locus, state))"
FREQ = COUNTS + ", freqs AS (SELECT locus, state, n, n / (SELECT count(DISTINCT sample_id) FROM cells)::DOUBLE AS freq FROM counts)"
DOC_FREQ = FREQ.replace("count(DISTINCT sample_id) FROM cells", "count(*) FROM documents")


def weighted(pc: float) -> str:
    return f"""{GRID}, w AS (SELECT sample_id, weight * multiplicity AS w FROM samples), weighted AS (
  SELECT g.locus, g.state, coalesce(weight, 0)::DOUBLE AS weight FROM grid g LEFT JOIN (SELECT locus, state, sum(w) AS weight FROM cells JOIN w USING (sample_id) GROUP BY 1, 2) USING (locus, state)),
wfreqs AS (SELECT locus, state, (weight + {pc}) / ((SELECT sum(w) FROM w) + {pc} * 5) AS freq FROM weighted)"""


def pairs(threshold: str) -> str:
    return f"""len AS (SELECT sample_id, count(*) AS l FROM cells GROUP BY 1),
same AS (SELECT a.sample_id AS i, b.sample_id AS j, count(*) FILTER (a.state = b.state) AS same FROM cells a JOIN cells b ON a.locus = b.locus AND a.sample_id > b.sample_id GROUP BY 1, 2),
idents AS (SELECT i, j, same, least(x.l, y.l) AS shorter FROM same JOIN len x ON x.sample_id = i JOIN len y ON y.sample_id = j),
near AS (SELECT * FROM idents WHERE {threshold}), linked AS (SELECT i AS sample_id, j AS other FROM near UNION ALL SELECT j, i FROM near)"""


REAL = "same::DOUBLE >= 0.35 * shorter"
ONES = "SELECT sample_id, 1.0::DOUBLE / (1 + count(other)) AS weight FROM len LEFT JOIN linked USING (sample_id) GROUP BY 1"


def listed(values: list[int], name: str) -> str:
    return f"{name} AS (SELECT unnest(range({len(values)}))::BIGINT AS ord, unnest({values})::BIGINT AS locus)"


SNP = "SELECT locus FROM freqs GROUP BY locus HAVING count(*) FILTER (state < 4 AND freq >= {maf}) > 1 AND max(freq) FILTER (state = 4) <= {gap}"
SUPPLIED = """supplied AS (SELECT DISTINCT l_suppkey AS set_id, l_partkey AS member FROM lineitem),
x AS (SELECT s.* FROM supplied s WHERE set_id + 1 IN (SELECT set_id FROM supplied)), y AS (SELECT set_id - 1 AS set_id, member FROM supplied s WHERE set_id - 1 IN (SELECT set_id FROM supplied))"""
EDGES = """met AS (SELECT l_suppkey AS a, l_partkey AS b, round(sum(l_quantity), 2) AS weight FROM lineitem GROUP BY 1, 2),
edges AS (SELECT least(a, b) AS i, greatest(a, b) AS j, weight::DOUBLE AS weight, weight > 40 AS flag FROM met)"""
RUNS = """marked AS (SELECT user_id, event_type, ts, event_id, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
runs AS (SELECT user_id, event_type, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS run FROM marked)"""
VECS = "v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), p AS (SELECT vec_id, unnest(v) AS a, unnest(list_reverse(v)) AS b, unnest(range(len(v))) AS k FROM v)"
BINS = "bins AS (SELECT round({x} / {w})::BIGINT AS bin, count(*) AS cnt, avg({x}) AS mean, var_pop({x}) AS variance FROM {t} WHERE {skip} GROUP BY 1)"
DISCOUNT = BINS.format(x="l_discount", w="0.01::DOUBLE", t="lineitem", skip="l_discount <> 0")
EMB_CROSS = """crossed AS (SELECT a.locus AS locus_i, b.locus AS locus_j, a.state AS state_i, b.state AS state_j, sum(s.weight) AS weight FROM cells a JOIN cells b ON a.sample_id = b.sample_id AND a.locus < b.locus JOIN samples s ON s.sample_id = a.sample_id GROUP BY 1, 2, 3, 4),
full25 AS (SELECT locus_i, locus_j, state_i, state_j, coalesce(weight, 0)::DOUBLE AS weight FROM (SELECT DISTINCT locus_i, locus_j FROM crossed) CROSS JOIN (SELECT range::INTEGER AS state_i FROM range(5)) CROSS JOIN (SELECT range::INTEGER AS state_j FROM range(5)) LEFT JOIN crossed USING (locus_i, locus_j, state_i, state_j))"""
TRANS = "trans AS (SELECT locus AS ord, locus * 3 + 2 AS locus FROM (SELECT DISTINCT unnest([i, j]) AS locus FROM edges)), size AS (SELECT max(locus) + 1 AS size FROM trans)"


def _moments(n: str) -> str:
    return f"""WITH {DISCOUNT}, m AS (SELECT sum(cnt)::BIGINT AS cnt, count(*) AS bincount, sum(mean * cnt) / {n} AS mean, sum((variance + mean * mean) * cnt) / {n} AS square FROM bins)
SELECT cnt, bincount, round(mean, 6) AS mean, round(square - mean * mean, 6) AS variance, round(sqrt(greatest(square - mean * mean, 0)), 6) AS std FROM m"""


SPANS = """spans AS (SELECT l_suppkey AS set_id, l_returnflag AS flag, unnest(range(l_orderkey, l_orderkey + l_quantity::BIGINT - 2)) AS x FROM lineitem),
a AS (SELECT DISTINCT set_id, x FROM spans WHERE flag = 'A'), b AS (SELECT DISTINCT set_id, x FROM spans WHERE flag IN ({other}))"""


def _intervals(members: str, other: str = "'N', 'R'") -> str:
    return f"""WITH {SPANS.format(other=other)}, m AS ({members}), r AS (SELECT set_id, x, x - row_number() OVER (PARTITION BY set_id ORDER BY x) AS run FROM m)
SELECT set_id, min(x) AS first, max(x) AS last FROM r GROUP BY set_id, run"""


ORACLE_SQL = {
    "state_counts": f"WITH {EMB}, {COUNTS} SELECT * FROM counts",
    "state_frequencies": f"WITH {EMB}, {FREQ.replace('count(DISTINCT sample_id) FROM cells', 'count(*) FROM embeddings')} SELECT locus, state, n, round(freq, 6) AS freq FROM freqs",
    "document_state_counts": f"WITH {DOC}, {COUNTS} SELECT * FROM counts",
    "allele_occurrence": f"WITH {EMB}, {GRID} SELECT g.locus, g.state, coalesce(n, 0)::BIGINT AS n FROM grid g LEFT JOIN (SELECT locus, state, sum(multiplicity) AS n FROM cells JOIN samples USING (sample_id) GROUP BY 1, 2) USING (locus, state)",
    "weighted_counts": f"WITH {EMB}, {weighted(0)} SELECT locus, state, round(weight, 6) AS weight FROM weighted",
    "weighted_frequencies": f"WITH {EMB}, {weighted(0.5)} SELECT locus, state, round(freq, 6) AS freq FROM wfreqs",
    "column_entropy": f"WITH {EMB}, {weighted(0.5)} SELECT locus, round(-sum(CASE WHEN freq > 0 THEN freq * ln(freq) ELSE 0 END), 6) AS entropy FROM wfreqs GROUP BY 1",
    "entropy_filter": f"WITH {EVT}, {FREQ} SELECT locus FROM freqs GROUP BY 1 HAVING -sum(CASE WHEN freq > 0 THEN freq * ln(freq) ELSE 0 END) > 1.45",
    "effective_size": f"WITH {EMB} SELECT round(sum(multiplicity * weight), 6) AS neff FROM samples",
    "state_presence": f"WITH {DOC}, m AS (SELECT locus, bit_or(1 << state) AS mask FROM cells GROUP BY 1) SELECT locus, mask::INTEGER AS mask, bit_count(mask)::INTEGER AS n_states, (mask & 15)::INTEGER AS mask_wo_gap, (mask & 16)::INTEGER AS gap_bit FROM m",
    "state_distribution": f"WITH {DOC}, m AS (SELECT locus, count(DISTINCT state)::INTEGER AS n_states FROM cells GROUP BY 1) SELECT n_states, count(*) AS positions, n_states > 1 AS polymorphic FROM m GROUP BY 1",
    "snp_filter": f"WITH {EMB}, {FREQ} {SNP.format(maf=0.01, gap=0.15)}",
    "snp_filter_loose": f"WITH {DOC}, {DOC_FREQ} {SNP.format(maf=0.05, gap=1.0)}",
    "subset_columns": f"WITH {EMB}, {listed(LEFT, 'l')} SELECT sample_id, ord::INTEGER AS locus, state FROM cells JOIN l USING (locus)",
    "include_loci": f"WITH {EMB} SELECT * FROM cells WHERE locus IN (SELECT unnest({LEFT}))",
    "exclude_loci": f"WITH {EMB} SELECT * FROM cells WHERE locus NOT IN (SELECT unnest({LEFT}))",
    "combine_loci": f"WITH {EMB}, {FREQ}, f AS ({SNP.format(maf=0.01, gap=0.15)}), k AS (SELECT row_number() OVER (ORDER BY locus) - 1 AS ord, locus::BIGINT AS locus FROM f), {listed(LEFT, 'l')} SELECT l.ord, k.locus FROM l JOIN k ON l.locus = k.ord",
    "loci_difference": "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS ord, o_custkey AS locus FROM orders QUALIFY o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)",
    "numbered_loci": f"WITH {DOC}, {DOC_FREQ}, f AS ({SNP.format(maf=0.05, gap=1.0)}) SELECT row_number() OVER (ORDER BY locus) - 1 AS ord, locus::BIGINT AS locus FROM f",
    "subsample_rows": f"WITH {EMB}, {listed([7, 3, 11, 450], 'l')} SELECT ord AS sample_id, cells.locus, state FROM cells JOIN l ON l.locus = cells.sample_id",
    "hamming_distance": f"WITH {EMB}, {pairs(REAL)} SELECT i, j, (shorter - same)::INTEGER AS distance FROM idents",
    "fract_identical": f"WITH {EVT}, {pairs(REAL)} SELECT i, j, round(CASE WHEN shorter = 0 THEN 0 ELSE same::DOUBLE / shorter END, 6) AS identity FROM idents",
    "similar_pairs": f"WITH {EMB}, {pairs(REAL)} SELECT i, j, same::INTEGER AS same, shorter::INTEGER AS shorter FROM near",
    "similar_days": f"WITH {EVT}, {pairs('same >= 0.9::DOUBLE * shorter')} SELECT i, j, same::INTEGER AS same, shorter::INTEGER AS shorter FROM near",
    "similar_lines": f"""WITH {LINE}, seq AS (SELECT sample_id, string_agg(state::VARCHAR, '' ORDER BY locus) AS s FROM cells GROUP BY 1), p AS (SELECT DISTINCT s FROM seq),
q AS (SELECT a.s AS first, b.s AS second, (SELECT count(*) FROM range(1, 6) t(k) WHERE substr(a.s, k::INT, 1) = substr(b.s, k::INT, 1)) AS same FROM p a JOIN p b ON a.s < b.s) SELECT first, second, same::INTEGER AS same FROM q WHERE same >= 4""",
    "sample_weights": f"WITH {EMB}, {pairs(REAL)}, w AS ({ONES}) SELECT sample_id, round(weight, 6) AS weight FROM w",
    "sample_weights_multiplicity": f"WITH {EMB}, {pairs(REAL)} SELECT s.sample_id, round(s.multiplicity / (s.multiplicity + coalesce(sum(o.multiplicity), 0))::DOUBLE, 6) AS weight FROM samples s LEFT JOIN linked b ON b.sample_id = s.sample_id LEFT JOIN samples o ON o.sample_id = b.other GROUP BY s.sample_id, s.multiplicity",
    "sample_weights_truncated": f"WITH {EVT}, {pairs('same >= 10')}, w AS ({ONES}) SELECT sample_id, round(weight, 6) AS weight FROM w",
    "sample_weights_rescaled": f"WITH {EMB}, {pairs(REAL)}, w AS ({ONES}) SELECT sample_id, round(weight * (SELECT count(*) / sum(weight) FROM w), 6) AS weight FROM w",
    "pair_diagnostics": f"WITH {EMB}, {pairs(REAL)}, f AS (SELECT same::DOUBLE / shorter AS f FROM idents) SELECT count(*) AS pairs, round(min(f), 6) AS least, round(max(f), 6) AS greatest, count(*) FILTER (f < 0.35::DOUBLE) AS apart, round(count(*) FILTER (f < 0.35::DOUBLE) / count(*)::DOUBLE, 6) AS apart_ratio FROM f",
    "fuse_duplicates": f"WITH {SEQ} SELECT min(sample_id) AS sample_id, count(*) AS multiplicity, length(sequence)::INTEGER AS n_loci FROM sequences GROUP BY sequence",
    "crosstable_pair": f"""WITH {LINE}, c AS (SELECT a.state AS state_i, b.state AS state_j, sum(a.weight) AS weight FROM cells a JOIN cells b USING (sample_id) WHERE a.locus = 0 AND b.locus = 1 GROUP BY 1, 2)
SELECT 0::INTEGER AS locus_i, 1::INTEGER AS locus_j, state_i, state_j, round(coalesce(weight, 0), 6)::DOUBLE AS weight FROM (SELECT range::INTEGER AS state_i FROM range(5)) CROSS JOIN (SELECT range::INTEGER AS state_j FROM range(5)) LEFT JOIN c USING (state_i, state_j)""",
    "crosstable_tile": f"WITH {LINE} SELECT a.locus AS locus_i, b.locus AS locus_j, a.state AS state_i, b.state AS state_j, round(count(*), 6)::DOUBLE AS weight FROM cells a JOIN cells b USING (sample_id) WHERE a.locus < b.locus GROUP BY 1, 2, 3, 4",
    "crosstable_pseudocount": f"WITH {EMB}, {EMB_CROSS} SELECT locus_i, locus_j, state_i, state_j, round(weight + 0.5, 6) AS weight FROM full25",
    "block_intersection_weights": f"""WITH {EVT}, l AS (SELECT sample_id, string_agg(state::VARCHAR, '' ORDER BY locus) AS i FROM cells WHERE locus < 15 GROUP BY 1), r AS (SELECT sample_id, string_agg(state::VARCHAR, '' ORDER BY locus) AS j FROM cells WHERE locus >= 15 GROUP BY 1)
SELECT i, j, round(sum(1.0::DOUBLE + sample_id % 3), 6) AS weight FROM l JOIN r USING (sample_id) GROUP BY 1, 2""",
    "gauge_zero_sum": f"WITH {EMB}, {EMB_CROSS} SELECT locus_i, locus_j, state_i, state_j, round(weight, 6) AS weight, round(weight - avg(weight) OVER (PARTITION BY locus_i, locus_j, state_i) - avg(weight) OVER (PARTITION BY locus_i, locus_j, state_j) + avg(weight) OVER (PARTITION BY locus_i, locus_j), 6) + 0.0::DOUBLE AS gauged FROM full25",
    "block_dictionary": f"""WITH {EMB}, w AS (SELECT sample_id, (locus // 32)::INTEGER AS block, string_agg(state::VARCHAR, '' ORDER BY locus) AS word FROM cells GROUP BY 1, 2)
SELECT block, word, min(sample_id) AS first_sample, count(*) AS carriers FROM w GROUP BY 1, 2""",
    "block_indices": f"""WITH {EVT}, w AS (SELECT sample_id, (locus // 32)::INTEGER AS block, string_agg(state::VARCHAR, '' ORDER BY locus) AS word FROM cells GROUP BY 1, 2),
k AS (SELECT block, word, (row_number() OVER (PARTITION BY block ORDER BY min(sample_id)) - 1)::INTEGER AS word_number FROM w GROUP BY 1, 2) SELECT sample_id, block, word_number FROM w JOIN k USING (block, word)""",
    "block_statistics": f"""WITH {SEQ}, w AS (SELECT sample_id, b AS block, substr(sequence, (b * 32 + 1)::INT, 32) AS word FROM (SELECT sample_id, sequence, unnest(range((length(sequence) - 1) // 32 + 1)) AS b FROM sequences WHERE sequence <> '')),
per AS (SELECT block, count(DISTINCT word) AS n, count(*) AS all_rows FROM w GROUP BY 1), ranked AS (SELECT *, row_number() OVER (ORDER BY n, block) - 1 AS place, count(*) OVER () AS size FROM per)
SELECT sum(n)::BIGINT AS words, min(n) AS least, (sum(n) // count(*))::BIGINT AS mean, max(n) FILTER (place = greatest(size // 2 - size % 2, 0)) AS median, max(n) AS most, count(*) AS strips, (sum(n) * 32)::BIGINT AS bytes, round(sum(n) / sum(all_rows)::DOUBLE, 6) AS ratio FROM ranked""",
    "freq_histogram": f"WITH {EMB}, {FREQ}, {BINS.format(x='freq', w='0.01::DOUBLE', t='freqs', skip='freq <> 0')} SELECT bin, cnt, round(mean, 6) AS mean, round(variance, 6) AS variance FROM bins",
    "hist_moments": _moments("sum(cnt)"),
    "hist_moments_compat": _moments("(sum(cnt) - 1)"),
    "hist_cumulative": f"WITH {BINS.format(x='l_tax', w='0.01::DOUBLE', t='lineitem', skip='true')} SELECT bin, cnt, (sum(cnt) OVER (ORDER BY bin))::BIGINT AS running FROM bins",
    "set_intersection": f"WITH {SUPPLIED} SELECT set_id, member FROM x JOIN y USING (set_id, member)",
    "set_union": f"WITH {SUPPLIED} SELECT * FROM x UNION SELECT * FROM y",
    "set_differences": f"WITH {SUPPLIED} SELECT set_id, 'only_a' AS side, member FROM (SELECT * FROM x EXCEPT SELECT * FROM y) UNION ALL SELECT set_id, 'only_b', member FROM (SELECT * FROM y EXCEPT SELECT * FROM x)",
    "set_split": f"WITH {SUPPLIED} SELECT set_id, (count(*) FILTER (b IS NULL))::INTEGER AS only_a, (count(*) FILTER (a IS NULL))::INTEGER AS only_b, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL)::INTEGER AS both FROM (SELECT set_id, member, 1 AS a FROM x) FULL JOIN (SELECT set_id, member, 1 AS b FROM y) USING (set_id, member) GROUP BY 1",
    "set_overlap": f"""WITH {SUPPLIED}, n AS (SELECT set_id, count(*) FILTER (a = 1 AND b = 1) AS k, bool_and(a = 1 AND b = 1) AS eq FROM (SELECT set_id, member, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM (SELECT *, 1 AS a FROM x) FULL JOIN (SELECT *, 1 AS b FROM y) USING (set_id, member)) GROUP BY 1),
f AS (SELECT set_id, min(member) AS m FROM y GROUP BY 1) SELECT set_id, k > 0 AS overlap, k::INTEGER AS size, EXISTS (SELECT 1 FROM x WHERE x.set_id = n.set_id AND x.member = f.m) AS has_first, eq AS equal FROM n JOIN f USING (set_id)""",
    "set_union_all": f"WITH {SUPPLIED} SELECT DISTINCT s_nationkey AS nation, member FROM supplied JOIN supplier ON set_id = s_suppkey",
    "set_gather": f"WITH {SUPPLIED} SELECT set_id, round(sum(p_retailprice), 2) AS weight FROM supplied JOIN part ON member = p_partkey GROUP BY 1",
    "set_gather_parts": f"""WITH {SUPPLIED}, p AS (SELECT set_id, p_retailprice AS w, a, b FROM (SELECT set_id, member, 1 AS a FROM x) FULL JOIN (SELECT set_id, member, 1 AS b FROM y) USING (set_id, member) JOIN part ON member = p_partkey)
SELECT set_id, round(coalesce(sum(w) FILTER (b IS NULL), 0), 2)::DOUBLE AS only_a, round(coalesce(sum(w) FILTER (a IS NULL), 0), 2)::DOUBLE AS only_b, round(coalesce(sum(w) FILTER (a = 1 AND b = 1), 0), 2)::DOUBLE AS both FROM p GROUP BY 1""",
    "range_encode": f"""WITH {SUPPLIED}, g AS (SELECT set_id, min(member) AS a, max(member) AS b FROM (SELECT *, member - row_number() OVER (PARTITION BY set_id ORDER BY member) AS run FROM supplied) GROUP BY set_id, run)
SELECT set_id, string_agg(lower(CASE WHEN a = b THEN to_hex(a) ELSE to_hex(a) || '-' || to_hex(b) END), ',' ORDER BY a) AS text FROM g GROUP BY 1""",
    "rle_encode": f"WITH {RUNS} SELECT user_id, run::BIGINT AS run, event_type, count(*) AS count FROM runs GROUP BY 1, 2, 3",
    "rle_decode": "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place, event_type FROM events",
    "graph_build": f"WITH {EDGES} SELECT * FROM edges",
    "graph_sort": f"WITH {EDGES} SELECT * FROM edges ORDER BY weight DESC, j, i",
    "graph_nodes": f"WITH {EDGES} SELECT DISTINCT unnest([i, j]) AS locus FROM edges WHERE weight > 45",
    "graph_union": f"WITH {EDGES} SELECT i, j, count(*) AS edges, round(sum(weight), 2) AS weight FROM (SELECT * FROM edges WHERE flag UNION ALL SELECT * FROM edges WHERE weight > 30) GROUP BY 1, 2",
    "graph_output": f"WITH {EDGES}, {TRANS} SELECT p.locus + 1 AS pos1, q.locus + 1 AS pos2, least((SELECT size FROM size) - abs(p.locus - q.locus), abs(p.locus - q.locus)) AS distance, flag::INTEGER AS flag, printf('%.6f', weight) AS weight FROM edges JOIN trans p ON i = p.ord JOIN trans q ON j = q.ord",
    "genome_distance": f"WITH {EDGES}, {TRANS} SELECT p.locus AS pos1, q.locus AS pos2, abs(p.locus - q.locus) AS distance FROM edges JOIN trans p ON i = p.ord JOIN trans q ON j = q.ord",
    "distance_linear": "SELECT o_orderkey, abs(o_orderkey - o_custkey) AS distance FROM orders",
    "distance_circular": "SELECT o_orderkey, least(1000 - abs(o_orderkey % 1000 - o_custkey % 1000), abs(o_orderkey % 1000 - o_custkey % 1000)) AS distance FROM orders",
    "vector_arith": f'WITH {VECS} SELECT vec_id, round(sum(a + b), 5) + 0.0::DOUBLE AS plus, round(sum(a - b + 1), 5) + 0.0::DOUBLE AS minus, round(sum(a * b), 5) + 0.0::DOUBLE AS times, round(sum(a / (b * b + 1)), 5) + 0.0::DOUBLE AS "over" FROM p GROUP BY 1',
    "vector_distance": f"WITH {VECS} SELECT vec_id, round(sum((a - b) * (a - b)), 6) AS square, round(sqrt(sum((a - b) * (a - b))), 6) AS distance, round(sqrt(sum(a * a)), 6) AS norm FROM p GROUP BY 1",
    "xlogx_family": "SELECT l_orderkey, round(sum(x * ln(x)), 5) AS xlogx, round(sum(x + ln(x)), 5) AS xaddlogx, round(sum(CASE WHEN l_discount = 0 THEN 0 ELSE l_discount * ln(l_discount) END), 5) AS guarded FROM (SELECT *, l_extendedprice / 1000 AS x FROM lineitem) GROUP BY 1",
    "mask_ops": f"WITH {VECS}, m AS (SELECT vec_id, abs(a) + 0.5 AS x FROM p WHERE k < 7 AND (89 >> k::INT) & 1 = 1) SELECT vec_id, round(sum(x), 6) AS summed, round(sum(CASE WHEN x = 0 THEN 0 ELSE x * ln(x) END), 6) AS xlogx, round(sum(x + ln(x)), 6) AS xaddlogx, bit_count(vec_id)::INTEGER AS bits, (vec_id >> 2) & 1 = 1 AS third FROM m GROUP BY 1",
    "integer_power": "SELECT p_partkey, pow(p_size % 10, 5)::BIGINT AS power FROM part",
    "char_to_state": "SELECT CASE lower(c) WHEN 'a' THEN 0 WHEN 't' THEN 1 WHEN 'c' THEN 2 WHEN 'g' THEN 3 ELSE 4 END AS state, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) GROUP BY 1",
    "state_to_char": f"WITH {SEQ} SELECT sample_id, length(sequence)::INTEGER AS n_loci, md5(sequence) AS digest FROM sequences",
    "merged_states": f"WITH {EVT} SELECT a.sample_id, a.locus, CASE WHEN a.state = 4 THEN b.state ELSE a.state END AS state FROM cells a JOIN cells b ON b.sample_id = a.sample_id + 1 AND b.locus = a.locus",
    "block_helpers": "SELECT o_orderkey, (o_orderkey // 32)::INTEGER AS block, (o_orderkey % 32)::INTEGER AS place, (o_orderkey // 32 * 32)::INTEGER AS first, ((o_orderkey + 31) // 32)::INTEGER AS blocks, ((o_orderkey + 31) % 32 + 1)::INTEGER AS last_size, 'L' || o_orderkey || 'n' || o_custkey AS size FROM orders",
    "phandango_pivot": f"""WITH {EVT}, h AS (SELECT -1::BIGINT AS place, '"locus",' || string_agg('"L' || (locus + 1) || ':o1"', ',' ORDER BY locus) || ',"L1:o1"' AS line FROM (SELECT DISTINCT locus FROM cells)),
b AS (SELECT sample_id AS place, '"' || sample_id || '",' || string_agg('"' || substr('atcg-', state + 1, 1) || '"', ',' ORDER BY locus) || ',"' || arg_min(substr('atcg-', state + 1, 1), locus) || '"' AS line FROM cells GROUP BY 1) SELECT * FROM h UNION ALL SELECT * FROM b""",
    "distance_triangle_text": f"""WITH {EVT}, {pairs(REAL)}, t AS (SELECT i, string_agg((shorter - same)::VARCHAR || ' ', '' ORDER BY j) AS body FROM idents GROUP BY 1)
SELECT sample_id AS place, (CASE WHEN sample_id = (SELECT min(sample_id) FROM len) THEN 'n=' || (SELECT count(*) FROM len) ELSE '' END) || coalesce(body, '') AS line FROM len LEFT JOIN t ON i = sample_id""",
    "fasta_lines": f"WITH {EVT} SELECT sample_id, '>' || sample_id || chr(10) || string_agg(substr('atcg-', state + 1, 1), '' ORDER BY locus) AS line FROM cells GROUP BY 1",
    "frequency_lines": f"WITH {EVT}, {COUNTS} SELECT locus, string_agg(printf('%d', n) || ' ', '' ORDER BY state) AS line FROM counts GROUP BY 1",
    "fasta_roundtrip": f"WITH {SEQ} SELECT sample_id, length(sequence)::INTEGER AS n_loci, md5(sequence) AS digest FROM sequences",
    "loci_list_roundtrip": f"WITH {EMB}, {FREQ}, f AS ({SNP.format(maf=0.01, gap=0.15)}), e AS (SELECT locus AS k, unnest([locus, locus + 1])::BIGINT AS locus FROM f) SELECT row_number() OVER (ORDER BY k, locus) - 1 AS ord, locus FROM e",
    "value_list_roundtrip": f"WITH {EMB}, {pairs(REAL)}, w AS ({ONES}) SELECT row_number() OVER (ORDER BY sample_id) - 1 AS ord, round(round(weight, 6), 6) AS value FROM w",
    "loci_texts": """WITH t AS (SELECT o_custkey, o_orderkey AS k, min(o_orderkey) FILTER (o_orderkey % 40 = 0) OVER (PARTITION BY o_custkey) AS bad FROM orders),
e AS (SELECT o_custkey, k, unnest(range(k, CASE WHEN k % 3 = 0 THEN k + 1 ELSE k + k % 5 END)) AS x FROM t WHERE bad IS NULL OR k < bad)
SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY k, x) - 1 AS ord, x - 1 AS locus FROM e""",
    "interval_fusion": _intervals("SELECT * FROM a UNION SELECT * FROM b", "'R'"),
    "interval_intersection": _intervals("SELECT * FROM a INTERSECT SELECT * FROM b"),
    "interval_difference": _intervals("SELECT * FROM a EXCEPT SELECT * FROM b"),
    "hybrid_roundtrip": _intervals("SELECT * FROM a UNION SELECT * FROM b", "'R'"),
    "hybrid_text": f"""WITH {SPANS.format(other="'R'")}, m AS (SELECT * FROM a UNION SELECT * FROM b), w AS (SELECT set_id, x // 32 AS w, bit_or(1::BIGINT << (x % 32)::INT) AS bits FROM m GROUP BY 1, 2),
r AS (SELECT *, w - row_number() OVER (PARTITION BY set_id, bits = 4294967295 ORDER BY w) AS run FROM w),
p AS (SELECT set_id, min(w) AS w, lower(to_hex(min(w) * 32)) || '-' || lower(to_hex((max(w) + 1) * 32)) AS t FROM r WHERE bits = 4294967295 GROUP BY set_id, run
  UNION ALL SELECT set_id, w, lower(to_hex(w * 32)) || ':' || lower(to_hex(bits)) FROM r WHERE bits <> 4294967295)
SELECT set_id, string_agg(t, ',' ORDER BY w) AS text FROM p GROUP BY set_id""",
    "zipped_rows": "SELECT ord, rich, named FROM (SELECT row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS ord, c_custkey AS rich FROM customer) JOIN (SELECT row_number() OVER (ORDER BY c_name, c_custkey) - 1 AS ord, c_custkey AS named FROM customer) USING (ord)",
    "equality_mask": f"""WITH {EVT}, e AS (SELECT a.sample_id AS i, b.sample_id AS j, list(a.locus ORDER BY a.locus) FILTER (a.state = b.state) AS l FROM cells a JOIN cells b ON b.sample_id + 1 = a.sample_id AND b.locus = a.locus GROUP BY 1, 2)
SELECT i, j, coalesce(list_sum(list_transform(l, lambda x: 1::BIGINT << x)), 0)::BIGINT AS bits, coalesce(len(l), 0)::INTEGER AS same, coalesce(len(list_filter(l, lambda x: x < 15)), 0)::INTEGER AS early, l[1] AS first, l[5] AS fifth FROM e""",
    "block_text_roundtrip": f"WITH {EVT} SELECT sample_id, 'days <1 & 2>' AS alignment, 1::BIGINT AS multiplicity, 1.0::DOUBLE AS weight, string_agg(substr('atcg-', state + 1, 1), '' ORDER BY locus) AS sequence FROM cells GROUP BY 1",
    "compression_statistics": f"""WITH {EVT}, w AS (SELECT sample_id, (locus // 32)::INTEGER AS block, string_agg(state::VARCHAR, '' ORDER BY locus) AS word FROM cells GROUP BY 1, 2),
f AS (SELECT block, word, sample_id // 32 AS w, count(*) = 32 AS whole FROM w GROUP BY 1, 2, 3), r AS (SELECT *, w - row_number() OVER (PARTITION BY block, word, whole ORDER BY w) AS run FROM f),
p AS (SELECT count(*) FILTER (NOT whole) + count(DISTINCT (block, word, run)) FILTER (whole) AS pieces FROM r),
n AS (SELECT (SELECT count(*) FROM cells) AS states, (SELECT count(*) * 32 FROM (SELECT DISTINCT block, word FROM w)) AS word_bytes, pieces * 8 AS index_bytes FROM p)
SELECT states, word_bytes, index_bytes, round(states / (word_bytes + index_bytes)::DOUBLE, 6) AS ratio, round((word_bytes + index_bytes) * 8 / states::DOUBLE, 6) AS bits_per_state FROM n""",
    "fasta_stream": f"WITH {SEQ} SELECT sample_id, length(sequence)::INTEGER AS n_loci, md5(sequence) AS digest FROM sequences",
    "prepared_alignment": f"""WITH {EVT}, u AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS n FROM (SELECT DISTINCT sample_id FROM cells)),
g AS (SELECT locus, state, count(*) / (SELECT count(*) FROM u)::DOUBLE AS freq FROM cells WHERE locus % 7 <> 2 GROUP BY 1, 2),
k AS (SELECT locus, row_number() OVER (ORDER BY locus) - 1 AS ord FROM g GROUP BY locus HAVING count(*) FILTER (state < 4 AND freq >= 0.16::DOUBLE) > 1 AND coalesce(max(freq) FILTER (state = 4), 0) <= 0.6::DOUBLE)
SELECT (n // 3)::BIGINT AS sample_id, cells.sample_id AS user_id, ord::INTEGER AS locus, cells.locus::BIGINT AS position, state FROM cells JOIN u USING (sample_id) JOIN k ON k.locus = cells.locus WHERE n % 3 = 0""",
    "keep_samples": f"WITH {EMB} SELECT * FROM cells WHERE sample_id IN (SELECT vec_id FROM embeddings WHERE label = 1)",
    "graph_found": f"WITH {EDGES}, w AS (SELECT DISTINCT least(l_partkey, l_suppkey) AS i, greatest(l_partkey, l_suppkey) AS j FROM lineitem WHERE l_returnflag = 'R') SELECT edges.* FROM edges JOIN w USING (i, j)",
    "graph_ordered_nodes": f"WITH {EDGES}, n AS (SELECT DISTINCT unnest([i, j]) AS locus FROM edges WHERE weight > 45) SELECT row_number() OVER (ORDER BY locus) - 1 AS ord, locus FROM n",
    "edge_lines": f"WITH {EDGES} SELECT i, j, i || ' ' || j || ' ' || regexp_replace(printf('%.2f', weight), '\\.?0+$', '') || ' ' || flag::INTEGER AS line FROM edges",
}
