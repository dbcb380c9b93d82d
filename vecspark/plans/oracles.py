"""DuckDB SQL with the results of the queries, written from the rules and not from the plans: greedy assignments go
through the vectors one by one."""

from __future__ import annotations

from vecspark.plans.settings import (
    AVERAGED,
    CENTRES,
    DEGREE,
    EPSILON,
    LAYER_SIZES,
    MERGED,
    PLUS_PLUS,
    REPLICAS,
    ROOM,
    SHARD,
    TASK_CAPACITY,
)

L2 = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"
IP = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
V = f"v AS (SELECT vec_id AS id, embedding AS vec, label FROM embeddings), q AS (SELECT id AS qid, vec AS qvec, label AS qlabel FROM v WHERE id % 100 = 0), c AS (SELECT id::INT AS shard, vec::DOUBLE[] AS centroid FROM v WHERE id < {CENTRES})"
QD = L2.format(a="vec", b="qvec")
COS = f"1 - {IP.format(a='vec', b='qvec')} / (sqrt({IP.format(a='vec', b='vec')}) * sqrt({IP.format(a='qvec', b='qvec')}))"
CD = f"cd AS (SELECT id, shard, {L2.format(a='vec', b='centroid')} AS dist FROM v, c), near AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, shard) AS rank FROM cd), home AS (SELECT id, shard, dist FROM near WHERE rank = 1)"
TOP2 = "SELECT * FROM near WHERE rank <= 2"
OVER = f"o AS (SELECT shard, row_number() OVER (PARTITION BY shard ORDER BY id) - 1 AS local_id, id AS global_id FROM ({TOP2}))"
MEANS = "means AS (SELECT shard, i, avg(x) AS m FROM (SELECT home.shard, unnest(range(0, len(vec))) AS i, unnest(vec)::DOUBLE AS x FROM home JOIN v USING (id)) GROUP BY ALL)"


def share(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def knn_sql(dist: str = QD, where: str = "true", out: str = "dist", more: str = "", ctes: str = "", top: int = 10) -> str:
    return f"""WITH {V}{ctes}, d AS (SELECT qid, id, {dist} AS dist FROM v, q WHERE {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM d)
SELECT qid, rank, id, {out} AS dist{more} FROM r WHERE rank <= {top}"""


def graph_sql(places: str, degree: int, name: str = "g") -> str:
    """CTEs of a neighbour graph of places(shard, local_id, global_id)."""
    return f"""{name}_p AS (SELECT shard, local_id, vec FROM {places} JOIN v ON id = global_id),
{name}_d AS (SELECT a.shard, a.local_id, b.local_id AS nbr_local, {L2.format(a='a.vec', b='b.vec')} AS dist FROM {name}_p a JOIN {name}_p b ON a.shard = b.shard AND a.local_id != b.local_id),
{name} AS (SELECT * FROM (SELECT shard, local_id, row_number() OVER (PARTITION BY shard, local_id ORDER BY dist, nbr_local) - 1 AS pos, nbr_local FROM {name}_d) WHERE pos < {degree})"""


def edges_sql(places: str, graph: str, name: str = "e") -> str:
    return f"{name} AS (SELECT x.global_id AS src, y.global_id AS dst, g.shard, pos FROM {graph} g JOIN {places} x USING (shard, local_id) JOIN {places} y ON y.shard = g.shard AND y.local_id = g.nbr_local)"


def merge_sql(edges: str, degree: int, name: str = "m") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT src, row_number() OVER (PARTITION BY src ORDER BY md5(concat_ws(':', '0', src::VARCHAR, dst::VARCHAR))) - 1 AS pos, dst
  FROM (SELECT DISTINCT src, dst FROM {edges} WHERE src != dst)) WHERE pos < {degree})"""


DIRECT = f"p AS (SELECT id // {SHARD} AS shard, id % {SHARD} AS local_id, id AS global_id FROM v)"
G = f"{DIRECT}, {graph_sql('p', DEGREE)}, {edges_sql('p', 'g')}, {merge_sql('e', MERGED)}"
GO = f"{CD}, {OVER}, {graph_sql('o', DEGREE)}, {edges_sql('o', 'g')}, {merge_sql('e', 2 * MERGED)}"
MERGED_WORK = ", w AS (SELECT (SELECT count(DISTINCT dst) FROM m) AS visited, (SELECT count(*) FROM v) + (SELECT count(DISTINCT dst) FROM m) AS computed)"
FULL = knn_sql(out="round(dist, 9) + 0.0", more=", visited, computed", ctes=f", {GO}{MERGED_WORK}").replace("FROM r WHERE", "FROM r, w WHERE")


def limit_sql(room: float) -> str:
    return f"ceil({room}::DOUBLE * (SELECT count(*) FROM v) / {CENTRES})::BIGINT"


CHOICES = "ch AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS i, list({'d': dist, 's': shard} ORDER BY dist, shard) AS c FROM cd GROUP BY id)"
NONE = f"list_transform(range({CENTRES}), lambda j: 0::BIGINT)"


def greedy_sql(name: str, rows: str, start: str, take: str, counted: str = "take") -> str:
    """CTEs of a pass through rows(i, id, c, ...) from 1 on: take is a list of (d, s), by used, the places taken so far."""
    return f"""{name} AS (
  SELECT 0::BIGINT AS i, NULL::BIGINT AS id, {start} AS used, NULL::STRUCT(d DOUBLE, s INTEGER)[] AS take
  UNION ALL
  SELECT i, id, list_transform(range({CENTRES}), lambda j: used[j + 1] + len(list_filter({counted}, lambda x: x.s = j))), take
  FROM (SELECT r.i, r.id, used, lim, {take} AS take FROM (SELECT {name}.used, {rows}.* FROM {name} JOIN {rows} ON {rows}.i = {name}.i + 1) r)
)"""


def last_sql(name: str) -> str:
    return f"(SELECT used FROM {name} ORDER BY i DESC LIMIT 1)"


TWO_ROUND = f"""WITH RECURSIVE {V}, {CD}, {CHOICES},
c1 AS MATERIALIZED (SELECT *, {limit_sql(ROOM['two_round'])} AS lim FROM ch),
{greedy_sql('r1', 'c1', NONE, 'list_filter(c, lambda x: used[x.s + 1] < floor(0.8::DOUBLE * lim))[:1]')},
c2 AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS i, c, lim FROM c1 JOIN r1 USING (id) WHERE len(take) = 0),
{greedy_sql('r2', 'c2', last_sql('r1'), 'list_filter(c, lambda x: used[x.s + 1] < lim)[:1]')},
homes AS MATERIALIZED (SELECT id, take[1].s AS shard, take[1].d AS dist FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2) WHERE len(take) = 1),
rad AS (SELECT shard, max(dist) AS radius FROM homes GROUP BY shard),
fit AS (SELECT cd.id, list({{'d': cd.dist, 's': cd.shard}} ORDER BY cd.dist, cd.shard) AS c FROM cd JOIN homes h ON h.id = cd.id JOIN rad ON rad.shard = cd.shard
  WHERE cd.shard != h.shard AND cd.dist < {EPSILON}::DOUBLE * h.dist AND cd.dist < {2 * EPSILON}::DOUBLE * radius GROUP BY cd.id),
c3 AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS i, c, {limit_sql(ROOM['two_round'])} AS lim FROM fit),
{greedy_sql('r3', 'c3', f"(SELECT list(n ORDER BY s) FROM (SELECT s, (SELECT count(*) FROM homes WHERE shard = s) AS n FROM (SELECT unnest(range({CENTRES})) AS s)))", f'list_filter(c, lambda x: used[x.s + 1] < lim)[:{REPLICAS - 1}]')},
two AS (SELECT id, shard, dist, true AS home FROM homes UNION ALL SELECT id, t.s, t.d, false FROM (SELECT id, unnest(take) AS t FROM r3))"""

OPEN, FULL_ONES = "list_filter(c, lambda x: used[x.s + 1] < lim)", "list_filter(c, lambda x: used[x.s + 1] >= lim)"
SHORT = f"greatest(0, {REPLICAS} - len({OPEN}))"
NON_SELECTIVE = f"""WITH RECURSIVE {V}, {CD}, {CHOICES}, c1 AS MATERIALIZED (SELECT *, {limit_sql(ROOM['nonselective'])} AS lim FROM ch),
{greedy_sql('r1', 'c1', NONE, f'list_concat({OPEN}[:{REPLICAS}], CASE WHEN {SHORT} > 0 THEN {FULL_ONES}[len({FULL_ONES}) - {SHORT} + 1:] ELSE [] END)')}
SELECT id, t.s AS shard, t.d AS dist FROM (SELECT id, unnest(take) AS t FROM r1)"""

STATE = "{'n': 0, 'met': 0, 'total': 0.0::DOUBLE, 'mean': NULL::DOUBLE, 'd': %s, 's': %s, 'taken': []::STRUCT(d DOUBLE, s INTEGER)[], 'full': %s}"
MET = f"(a.n < {AVERAGED} AND coalesce(x.d <= {EPSILON}::DOUBLE * a.mean, true))"
FOLD = f"""list_reduce(list_transform(c, lambda x: {STATE % ('x.d', 'x.s', 'used[x.s + 1] >= lim')}), lambda a, x: {{
  'n': CASE WHEN {MET} AND NOT x.full THEN a.n + 1 ELSE a.n END, 'met': CASE WHEN {MET} THEN a.met + 1 ELSE a.met END, 'total': CASE WHEN {MET} THEN a.total + x.d ELSE a.total END,
  'mean': CASE WHEN {MET} AND x.full THEN NULL WHEN {MET} THEN (a.total + x.d) / (a.met + 1) ELSE a.mean END, 'd': x.d, 's': x.s,
  'taken': CASE WHEN {MET} AND NOT x.full THEN list_append(a.taken, {{'d': x.d, 's': x.s}}) ELSE a.taken END, 'full': x.full}}, {STATE % ('0.0::DOUBLE', '0', 'false')}).taken"""
RUNNING = f"""WITH RECURSIVE {V}, {CD}, {CHOICES}, c1 AS MATERIALIZED (SELECT *, {limit_sql(ROOM['running_avg'])} AS lim FROM ch),
{greedy_sql('r1', 'c1', NONE, FOLD)}
SELECT id, t.s AS shard, t.d AS dist FROM (SELECT id, unnest(take) AS t FROM r1)"""


def lloyd_sql(rounds: int) -> str:
    out = [f"c0 AS (SELECT shard, centroid FROM c)"]
    for r in range(rounds + 1):
        far = L2.format(a="vec", b="centroid")
        out.append(f"a{r} AS (SELECT id, vec, shard FROM (SELECT id, vec, shard, row_number() OVER (PARTITION BY id ORDER BY {far}, shard) AS rank FROM v, c{r}) WHERE rank = 1)")
        flat = f"SELECT shard, unnest(range(0, len(vec))) AS i, unnest(vec)::DOUBLE AS x FROM a{r}"
        mean = f"SELECT shard, list(m ORDER BY i) AS m FROM (SELECT shard, i, avg(x) AS m FROM ({flat}) GROUP BY ALL) GROUP BY shard"
        out.append(f"c{r + 1} AS MATERIALIZED (SELECT shard, coalesce(m, list_transform(centroid, lambda _: 0.0::DOUBLE)) AS centroid FROM c{r} LEFT JOIN ({mean}) USING (shard))")
    return f"WITH {V}, {', '.join(out)} SELECT shard, count(*) AS n FROM a{rounds} GROUP BY shard"


def plus_plus_sql(k: int) -> str:
    out = [f"p0 AS (SELECT 0 AS shard, id, vec AS pv FROM (SELECT id, vec, row_number() OVER (ORDER BY id) - 1 AS place FROM v) WHERE place = floor({share(chr(39) + '1' + chr(39), chr(39) + '0' + chr(39))} * (SELECT count(*) FROM v)))"]
    for j in range(1, k):
        chosen = " UNION ALL ".join(f"SELECT pv FROM p{i}" for i in range(j))
        out.append(f"d{j} AS (SELECT id, min({L2.format(a='vec', b='pv')}) AS dist FROM v, ({chosen}) GROUP BY id)")
        out.append(f"s{j} AS (SELECT id, sum(dist) OVER (ORDER BY id) AS run, sum(dist) OVER () AS whole FROM d{j})")
        part = share("'1'", f"'{j}'")
        out.append(f"p{j} AS MATERIALIZED (SELECT {j} AS shard, id, vec AS pv FROM v WHERE id = (SELECT min(id) FROM s{j} WHERE run >= {part} * whole))")
    return f"WITH {V}, {', '.join(out)} " + " UNION ALL ".join(f"SELECT shard, id FROM p{j}" for j in range(k))


DISTRIBUTION = f"""sizes AS (SELECT id // 128 AS block, count(*) AS whole FROM home GROUP BY 1),
cells AS (SELECT block, shard, whole, (SELECT count(*) FROM home h WHERE h.id // 128 = block AND h.shard = s.shard) AS n FROM sizes, (SELECT DISTINCT shard FROM home) s),
dist AS (SELECT block, shard, (1.0::DOUBLE / {CENTRES} + sum(n / whole) OVER w) / (count(*) OVER w + 1) AS share FROM cells WINDOW w AS (PARTITION BY shard ORDER BY block ROWS UNBOUNDED PRECEDING))"""
LAYERS = f"""sh AS (SELECT id // 250 AS shard, id % 250 AS local_id, id AS base_id, row_number() OVER (PARTITION BY id // 250 ORDER BY md5('0:' || id), id) AS place FROM v),
lay AS ({' UNION ALL '.join([f"SELECT shard, 0 AS layer, local_id AS local, base_id FROM sh"] + [f"SELECT shard, {i} AS layer, row_number() OVER (PARTITION BY shard ORDER BY base_id) - 1 AS local, base_id FROM sh WHERE place <= {n}" for i, n in enumerate(LAYER_SIZES) if i])})"""
TASKS = f"""t AS (SELECT label::BIGINT AS id, count(*) * 1000 AS n, len(any_value(vec)) AS d FROM v GROUP BY label),
t1 AS (SELECT id, n * d * 4 + n * 32 * 6 AS memory, row_number() OVER (ORDER BY n * d * 32 DESC, id) AS i FROM t WHERE id < 5),
pack AS (SELECT 0::BIGINT AS i, 0::BIGINT AS used, NULL::BIGINT AS id, false AS fits UNION ALL
  SELECT t1.i, used + CASE WHEN used + memory <= {int(TASK_CAPACITY * 0.9)} THEN memory ELSE 0 END, t1.id, used + memory <= {int(TASK_CAPACITY * 0.9)} FROM pack JOIN t1 ON t1.i = pack.i + 1),
taken AS (SELECT id, row_number() OVER (ORDER BY i) - 1 AS slot FROM pack WHERE fits)"""
GIB = "(0.5::DOUBLE * 1073741824)"
PLANS = f"""WITH base AS (SELECT times::BIGINT AS times, (SELECT count(*) FROM embeddings) * times AS n, (SELECT max(len(embedding)) FROM embeddings) AS dim FROM (SELECT unnest([1, 10000]) AS times)),
need AS (SELECT *, 1.15::DOUBLE * (n * dim * 4 + greatest(4 * n * 64 * 4, n * dim * 4) + 40 * n) AS needed FROM base),
parted AS (SELECT *, CASE WHEN {GIB} > needed THEN 1 ELSE floor((2 * needed - 1) / {GIB})::BIGINT + 1 END AS parts, CASE WHEN {GIB} > needed THEN n ELSE floor(n * {GIB} / needed)::BIGINT END AS most FROM need),
sampled AS (SELECT *, least(n, greatest(256000, least(1000 * parts, 8388608))) AS sample FROM parted),
grown AS (SELECT *, floor(pow(n / 32.0::DOUBLE, 1.0::DOUBLE / 3))::BIGINT AS low FROM sampled),
picked AS (SELECT *, CASE WHEN n / pow(low + 1, 3) < 24 OR abs(coalesce(n / nullif(pow(low, 3), 0), 'inf'::DOUBLE) - 32) < abs(n / pow(low + 1, 3) - 32) THEN low ELSE low + 1 END AS growth FROM grown)
SELECT times, parts, most, sample::BIGINT AS sample, least(0.05::DOUBLE, sample / n) AS rate,
  least(floor(0.05::DOUBLE * n)::BIGINT, floor(({GIB} - parts * 12 - parts * 8)::BIGINT / ((dim * 4 + 4) * 1.15::DOUBLE))::BIGINT, 8388608, n)::BIGINT AS room,
  growth, (n + 32 * (1 + growth + growth * growth))::BIGINT AS layer_rows, (32 * (1 + growth + growth * growth))::BIGINT AS translated FROM picked"""

ORACLES = {
    "knn_exact_topk": knn_sql(),
    "knn_ip_topk": knn_sql("-" + IP.format(a="vec", b="qvec")),
    "knn_cosine_topk": knn_sql(COS, out="round(dist, 9) + 0.0"),
    "knn_range_filter": knn_sql(where="id BETWEEN 100 AND 299"),
    "knn_within_label": knn_sql(where="label = qlabel"),
    "recall_at_k": f"""WITH {V}, d AS (SELECT qid, id, {QD} AS dist FROM v, q),
      t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM d) WHERE rank <= 10),
      f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM d WHERE id % 3 != 1) WHERE rank <= 10)
      SELECT count(*) AS n_queries, round(avg(r), 6) AS recall FROM (SELECT qid, 100.0::DOUBLE * count(f.id) / count(*) AS r FROM t LEFT JOIN f USING (qid, id) GROUP BY qid)""",
    "valid_results": f"SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank, id, dist FROM ({knn_sql(top=15)}) WHERE id < 300",
    "vectors_by_id": f"WITH {V} SELECT qid AS id, unnest(range(0, len(qvec)))::INT AS i, unnest(qvec)::DOUBLE AS x FROM q",
    "shard_direct": f"SELECT vec_id // {SHARD} AS shard, vec_id % {SHARD} AS local_id, vec_id AS global_id FROM embeddings",
    "shard_direct_sizes": f"SELECT vec_id // {SHARD} AS shard, count(*) AS n FROM embeddings GROUP BY 1",
    "shard_search_gather": knn_sql(),
    "sample_rows": f"SELECT vec_id AS id FROM embeddings WHERE {share(chr(39) + '0' + chr(39), 'vec_id::VARCHAR')} < 0.3::DOUBLE",
    "sample_with_replacement": f"SELECT draw, floor({share(chr(39) + '0' + chr(39), 'draw::VARCHAR')} * (SELECT count(*) FROM embeddings))::BIGINT AS id FROM (SELECT unnest(range(100)) AS draw)",
    "random_centres": f"SELECT shard::INT AS shard, i::INT AS i, round(2 * {share(chr(39) + '0' + chr(39), 'shard::VARCHAR', 'i::VARCHAR')} - 1, 9) AS x FROM (SELECT unnest(range({CENTRES})) AS shard), (SELECT unnest(range(4)) AS i)",
    "kmeans_assign": f"WITH {V}, {CD} SELECT * FROM home",
    "kmeans_update": f"WITH {V}, {CD}, {MEANS} SELECT c.shard, i::INT AS i, round(coalesce(m, 0), 9) AS m FROM (SELECT shard, unnest(range(0, len(centroid))) AS i FROM c) c LEFT JOIN means USING (shard, i)",
    "kmeans_residual": f"WITH {V}, {CD} SELECT round(sum(dist), 6) AS residual FROM home",
    "kmeans_lloyd_3": lloyd_sql(3),
    "kmeans_lloyd_simple_3": lloyd_sql(3),
    "kmeans_seed_step": f"WITH {V}, {CD}, run AS (SELECT id, sum(dist) OVER (ORDER BY id) AS r, sum(dist) OVER () AS t FROM home) SELECT min(id) AS id FROM run WHERE r >= 0.4 * t",
    "kmeans_plus_plus": plus_plus_sql(PLUS_PLUS),
    "assign_nearest_k": f"WITH {V}, {CD} {TOP2}",
    "assign_two_round": f"{TWO_ROUND} SELECT * FROM two",
    "assign_nonselective": NON_SELECTIVE,
    "assign_running_avg": RUNNING,
    "shard_stats": f"WITH {V}, {CD} SELECT shard, count(*) AS n, max(dist) AS radius FROM ({TOP2}) GROUP BY shard",
    "shard_home_radius": f"{TWO_ROUND} SELECT shard, count(*) AS n, max(dist) AS radius FROM two WHERE home GROUP BY shard",
    "shard_report": f"{TWO_ROUND} SELECT shard, count(*) AS n, sum(count(*)) OVER ()::BIGINT AS total, (SELECT count(DISTINCT id) FROM two) AS vectors, (SELECT count(*) / count(DISTINCT id) FROM two) AS replication FROM two GROUP BY shard",
    "running_distribution": f"WITH {V}, {CD}, {DISTRIBUTION} SELECT block, shard, round(share, 9) AS share FROM dist",
    "second_round_room": f"WITH {V}, {CD}, {DISTRIBUTION}, l AS (SELECT {limit_sql(ROOM['two_round'])} AS lim) SELECT block, shard, greatest(lim - floor(0.8::DOUBLE * lim), lim - floor(share * (SELECT count(*) FROM v)))::BIGINT AS room FROM dist, l",
    "estimated_sizes": f"WITH {V}, {CD} SELECT shard, floor(count(*) / 0.3::DOUBLE)::BIGINT AS n FROM ({TOP2}) WHERE {share(chr(39) + '0' + chr(39), 'id::VARCHAR')} < 0.3::DOUBLE GROUP BY shard",
    "local_ids": f"WITH {V}, {CD}, {OVER} SELECT * FROM o",
    "shard_knn_graph": f"WITH {V}, {G} SELECT * FROM g",
    "graph_rank_pruned": f"""WITH {V}, {DIRECT}, {graph_sql('p', 2 * DEGREE)},
      paths AS (SELECT a.shard, a.local_id, b.nbr_local, a.pos AS xz, b.pos AS zy FROM g a JOIN g b ON a.shard = b.shard AND a.nbr_local = b.local_id),
      counted AS (SELECT g.shard, g.local_id, g.nbr_local, g.pos, count(xz) AS n FROM g LEFT JOIN paths p ON p.shard = g.shard AND p.local_id = g.local_id AND p.nbr_local = g.nbr_local AND xz < g.pos AND zy < g.pos GROUP BY ALL)
      SELECT * FROM (SELECT shard, local_id, row_number() OVER (PARTITION BY shard, local_id ORDER BY n, pos) - 1 AS pos, nbr_local FROM counted) WHERE pos < {DEGREE}""",
    "graph_random": f"WITH {V}, {DIRECT}, s AS (SELECT shard, count(*) AS n FROM p GROUP BY shard) SELECT shard, local_id, pos, floor({share(chr(39) + '0' + chr(39), 'shard::VARCHAR', 'local_id::VARCHAR', 'pos::VARCHAR')} * n)::BIGINT AS nbr_local FROM p JOIN s USING (shard), (SELECT unnest(range({DEGREE})) AS pos)",
    "graph_remap": f"WITH {V}, {G} SELECT src, dst FROM e",
    "graph_ranges": f"WITH {V}, {G} SELECT src, dst FROM e",
    "graph_union": f"WITH {V}, {G} SELECT DISTINCT src, dst FROM e",
    "graph_merge_variable": f"WITH {V}, {G} SELECT * FROM m",
    "graph_merge_overlapping": f"WITH {V}, {GO} SELECT * FROM m",
    "graph_merge_fixed": f"WITH {V}, {G} SELECT * FROM m",
    "graph_merge_all": f"""WITH {V}, {GO}, n AS (SELECT *, count(*) OVER (PARTITION BY src) AS n FROM e),
      k AS (SELECT *, CASE WHEN n > {DEGREE} THEN md5(concat_ws(':', '0', src::VARCHAR, dst::VARCHAR, shard::VARCHAR, pos::VARCHAR)) END AS k FROM n)
      SELECT * FROM (SELECT src, row_number() OVER (PARTITION BY src ORDER BY k NULLS FIRST, shard, pos) - 1 AS pos, dst FROM k) WHERE pos < {DEGREE}""",
    "graph_degree_stats": f"WITH {V}, {G} SELECT count(*) AS n_nodes, sum(n)::BIGINT AS n_edges, min(n) AS least, max(n) AS most FROM (SELECT count(*) AS n FROM m GROUP BY src)",
    "node_shard_map": f"WITH {V}, {CD} SELECT id AS global_id, count(*) AS n_shards, min(shard) AS first_shard FROM ({TOP2}) GROUP BY id",
    "node_places": f"WITH {V}, {CD}, {OVER} SELECT global_id, shard, local_id FROM o",
    "shard_medoids": f"WITH {V}, {DIRECT}, pm AS (SELECT shard, list(m ORDER BY i) AS mean FROM (SELECT shard, i, avg(x) AS m FROM (SELECT shard, unnest(range(0, len(vec))) AS i, unnest(vec)::DOUBLE AS x FROM p JOIN v ON id = global_id) GROUP BY ALL) GROUP BY shard), f AS (SELECT shard, local_id, global_id, round({L2.format(a='vec', b='mean')}, 9) AS d FROM p JOIN v ON id = global_id JOIN pm USING (shard)) SELECT shard, local_id, global_id AS medoid FROM (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY d, global_id) AS r FROM f) WHERE r = 1",
    "label_medoids": f"WITH {V}, {DIRECT}, x AS (SELECT label, shard, id, unnest(range(0, len(vec))) AS i, unnest(vec)::DOUBLE AS x FROM p JOIN v ON id = global_id), a AS (SELECT label, shard, i, avg(x) AS m FROM x GROUP BY ALL), f AS (SELECT label, shard, id, round(sum((x - m) * (x - m)), 9) AS d FROM x JOIN a USING (label, shard, i) GROUP BY ALL) SELECT label, shard, id AS medoid FROM (SELECT *, row_number() OVER (PARTITION BY label, shard ORDER BY d, id) AS r FROM f) WHERE r = 1",
    "medoids_of_labels": f"WITH {V}, {DIRECT} SELECT local_id % 3 AS label, (row_number() OVER (PARTITION BY local_id % 3 ORDER BY shard, global_id) - 1)::INT AS place, global_id AS medoid FROM p WHERE local_id < 6",
    "beam_search_full_pool": knn_sql(out="round(dist, 9) + 0.0"),
    "merged_search_full_pool": FULL,
    "hop_search_full_pool": FULL,
    "merged_search_counters": f"WITH {V}, {GO}{MERGED_WORK} SELECT count(*) AS n_queries, (count(*) * any_value(visited))::BIGINT AS visited, (count(*) * any_value(computed))::BIGINT AS computed FROM q, w",
    "translated_search_full_pool": knn_sql(out="round(dist, 9) + 0.0"),
    "layer_members": f"WITH {V}, {LAYERS} SELECT * FROM lay",
    "layer_translation": f"WITH {V}, {LAYERS} SELECT a.shard, a.base_id, b.local FROM lay a JOIN lay b ON a.shard = b.shard AND a.base_id = b.base_id WHERE a.layer = 2 AND b.layer = 1",
    "task_pack": f"WITH RECURSIVE {V}, {TASKS} SELECT slot, id FROM taken",
    "task_states": f"""WITH RECURSIVE {V}, {TASKS} SELECT t.id, CASE WHEN t.id < 3 THEN 'completed' WHEN taken.id IS NOT NULL THEN 'running' WHEN t.id < 8 THEN 'ready' ELSE 'pending' END AS status,
      CASE WHEN taken.id IS NOT NULL THEN 1 END AS node FROM t LEFT JOIN taken ON taken.id = t.id""",
    "plan_partitions": PLANS,
}
ORACLES["entry_point"] = f"SELECT medoid FROM ({ORACLES['shard_medoids']}) ORDER BY shard DESC LIMIT 1"
