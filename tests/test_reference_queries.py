"""Every query against its SQL twin, and operators against serial versions on random inputs."""

from itertools import accumulate

import numpy as np
import pytest

import duckdb
from vecspark.functions import sizing
from vecspark.operators import graph, kmeans, knn, layers, scheduling, search, sharding
from vecspark.plans import registry

DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql_twin(spark, name):
    got = registry.QUERIES[name](spark, DIR)
    columns = sorted(got.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DIR}/embeddings.parquet'")
    wanted = con.sql(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(str, wanted))


def tables(spark, n, k, seed, most=50):
    """Random points and centres as tables, and for each point its (distance, centre) in order."""
    rng = np.random.default_rng(seed)
    points, middles = rng.integers(0, most, (n, 2)).astype(float), rng.integers(0, most, (k, 2)).astype(float)
    vectors = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, vec array<float>")
    centres = spark.createDataFrame([(10 * s, m.tolist()) for s, m in enumerate(middles)], "shard int, centroid array<double>")
    order = [sorted((float(((p - m) ** 2).sum()), 10 * s) for s, m in enumerate(middles)) for p in points]
    return vectors, centres, order


@pytest.mark.parametrize(("k", "replicas", "limit"), [(4, 2, 12), (4, 3, 5), (2, 3, 5), (6, 2, 11)])
def test_non_selective_equals_the_serial_rule_when_shards_fill_up(spark, k, replicas, limit):
    vectors, centres, order = tables(spark, 60, k, 5)
    found = sharding.non_selective(vectors, centres, replicas, limit)
    used, wanted = dict.fromkeys(range(0, 10 * k, 10), 0), []
    for i, near in enumerate(order):
        taken = 0
        for at, (d, s) in enumerate(near):
            if taken < replicas and (used[s] < limit or k - at <= replicas - taken):
                used[s] += 1
                taken += 1
                wanted.append((i, s, d))
    assert sorted(tuple(r) for r in found.collect()) == sorted(wanted) and max(used.values()) >= limit


@pytest.mark.parametrize(("k", "replicas", "limit", "epsilon"), [(5, 2, 30, 1.6), (4, 3, 50, 2.5), (8, 3, 25, 1.2), (3, 2, 40, 30.0)])
def test_running_average_equals_the_serial_rule(spark, k, replicas, limit, epsilon):
    vectors, centres, order = tables(spark, 60, k, 7 + k)
    used, wanted, met_full = dict.fromkeys(range(0, 10 * k, 10), 0), [], 0
    for i, near in enumerate(order):
        taken, met, total, mean = 0, 0, 0.0, float("inf")
        for d, s in near:
            if taken == replicas:
                break
            if d <= epsilon * mean:
                met, total = met + 1, total + d
                mean = total / met
                if used[s] < limit:
                    used[s], taken = used[s] + 1, taken + 1
                    wanted.append((i, s, d))
                else:
                    mean, met_full = float("inf"), met_full + 1
    assert sorted(tuple(r) for r in sharding.running_average(vectors, centres, replicas, limit, epsilon).collect()) == sorted(wanted)
    assert met_full or max(used.values()) < limit


@pytest.mark.parametrize(("k", "replicas", "limit", "epsilon"), [(5, 2, 13, 1.6), (4, 3, 16, 2.5), (6, 3, 40, 1.2), (5, 1, 12, 2.0)])
def test_two_round_equals_the_serial_rule(spark, k, replicas, limit, epsilon):
    vectors, centres, order = tables(spark, 60, k, k)
    used, homes = dict.fromkeys(range(0, 10 * k, 10), 0), {}
    for cap in (int(0.8 * limit), limit):
        for i, near in enumerate(order):
            if i not in homes and (room := [x for x in near if used[x[1]] < cap]):
                homes[i] = room[0]
                used[room[0][1]] += 1
    assert len(homes) == 60
    radius = {s: max([d for d, t in homes.values() if t == s], default=0.0) for s in used}
    wanted = [(i, s, d, True) for i, (d, s) in homes.items()]
    for i, near in enumerate(order):
        taken = 1
        for d, s in near:
            if taken < replicas and s != homes[i][1] and d < epsilon * homes[i][0] and d < 2 * epsilon * radius[s] and used[s] < limit:
                used[s], taken = used[s] + 1, taken + 1
                wanted.append((i, s, d, False))
    assert sorted(tuple(r) for r in sharding.two_round(vectors, centres, replicas, limit, epsilon).collect()) == sorted(wanted)


def test_assignments_fail_rather_than_lose_vectors(spark):
    vectors, centres, _ = tables(spark, 40, 3, 1)
    with pytest.raises(ValueError, match="room for 39 of 40"):
        sharding.two_round(vectors, centres, 2, 13, 1.2)
    with pytest.raises(ValueError, match="of 80"):
        sharding.running_average(vectors, centres, 2, 20, 1.2)
    one = centres.limit(1)
    assert sharding.two_round(vectors, one, 2, 40, 1.2).where("home").count() == 40
    assert sharding.two_round(vectors.limit(0), centres, 2, 13, 1.2).count() == 0


def test_waves_with_sparse_ids_and_small_ranges(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE", 64)
    vectors, centres, order = tables(spark, 50, 3, 3)
    far = vectors.selectExpr("id * 37 - 900 AS id", "vec")
    used, wanted = {0: 0, 10: 0, 20: 0}, []
    for i, near in enumerate(order):
        room = [x for x in near if used[x[1]] < 17][:1]
        for d, s in room:
            used[s] += 1
            wanted.append((i * 37 - 900, s, d))
    found = sharding.waves(sharding.choices(far, centres), [17] * 3, sharding.first_open(1)).select("id", "shard", "dist")
    assert sorted(tuple(r) for r in found.collect()) == sorted(wanted) and max(used.values()) == 17


def test_registered_assignments_are_total_at_every_size(spark):
    for size, n in (("sf0.001", 500), ("sf0.1", 2000)):
        d = f"/root/testdata/{size}"
        two = registry.two_round(spark, d)
        assert two.where("home").select("id").distinct().count() == n
        assert two.groupBy("shard").count().agg({"count": "max"}).first()[0] <= registry.limit(spark, d, registry.ROOM["two_round"])
        for name in ("assign_nonselective", "assign_running_avg"):
            assert registry.QUERIES[name](spark, d).select("id").distinct().count() == n


def points_of(spark, d=DIR):
    rows = registry.vectors(spark, d).orderBy("id").collect()
    return np.array([r.vec for r in rows], dtype=np.float64)


def plain_search(points, links, starts, query, pool):
    """The pool in the end, ids first visited as neighbours, and distances computed, by the plainest loop."""
    dist = lambda i: float(((points[i] - query) ** 2).sum())
    held, done, visited, computed = sorted((dist(i), i) for i in starts)[:pool], set(), set(), len(starts)
    while left := [x for x in held if x[1] not in done]:
        done.add(left[0][1])
        for j in links.get(left[0][1], []):
            if j not in visited:
                visited.add(j)
                computed += 1
                held = sorted({*held, (dist(j), j)})[:pool]
    return held, len(visited), computed


@pytest.mark.parametrize("pool", [10, 40])
def test_merged_search_equals_a_plain_loop(spark, pool):
    points, found = points_of(spark), registry.searched(spark, DIR, pool).collect()
    links: dict = {}
    for r in registry.merged(spark, DIR).collect():
        links.setdefault(r.src, []).append(r.dst)
    for q in range(0, 500, 100):
        held, visited, computed = plain_search(points, {k: sorted(v) for k, v in links.items()}, search.seeded_starts(500, pool, 0).tolist(), points[q], pool)
        rows = sorted((r for r in found if r.qid == q), key=lambda r: r["rank"])
        assert [r.id for r in rows] == [i for _, i in held[:10]]
        assert {(r.visited, r.computed) for r in rows} == {(visited, computed)}


def test_hops_equal_a_search_one_by_one(spark):
    few = registry.vectors(spark, DIR).where("id < 60")
    shards = sharding.direct(few, 60)
    edges = graph.remap(graph.shard_knn_graph(shards, few, 5), shards).cache()
    queries = few.where("id in (3, 50)").selectExpr("id AS qid", "vec AS qvec")
    found = search.search_hops(few, edges, queries, 4, 8).collect()
    points, links = points_of(spark)[:60], {}
    for r in edges.collect():
        links.setdefault(r.src, []).append(r.dst)
    starts = [r.id for r in few.orderBy(kmeans.seeded_share(0, few["id"]), "id").limit(8).collect()]
    for q in (3, 50):
        held, visited, computed = plain_search(points, links, starts, points[q], 8)
        rows = sorted((r for r in found if r.qid == q), key=lambda r: r["rank"])
        assert [r.id for r in rows] == [i for _, i in held[:4]] and {(r.visited, r.computed) for r in rows} == {(visited, computed)}
    wide = search.search_hops(few, edges, queries, 4, 8, width=3)
    assert knn.recall(wide, knn.knn(few, queries, 4)).first().recall >= 75


def test_layered_search_equals_a_plain_loop(spark):
    points, table = points_of(spark), registry.layered(spark, DIR).cache()
    rows = table.collect()
    found = registry.layered_found(spark, DIR, 12).collect()
    for q in (0, 300):
        best, visited, computed = [], 0, 0
        for shard in {r.shard for r in rows}:
            for layer in (2, 1, 0):
                own = sorted((r for r in rows if (r.shard, r.layer) == (shard, layer)), key=lambda r: r.local)
                base = {r.local: r.base_id for r in own}
                links = {r.base_id: sorted(base[x] for x in r.nbrs) for r in own}
                starts = [own[i].base_id for i in search.seeded_starts(len(own), 12, 0)] if layer == 2 else [i for _, i in held]
                held, seen, work = plain_search(points, links, starts, points[q], 12)
                visited, computed = visited + seen, computed + work
            best += held[:10]
        mine = sorted((r for r in found if r.qid == q), key=lambda r: r["rank"])
        assert [r.id for r in mine] == [i for _, i in sorted(best)[:10]] and {(r.visited, r.computed) for r in mine} == {(visited, computed)}


def test_recalls(spark):
    for name in ("beam_search_recall", "merged_search_recall", "translated_search_recall", "layered_search_recall"):
        assert registry.QUERIES[name](spark, DIR).first().recall >= 90, name


def test_pool_must_hold_k(spark):
    few = registry.vectors(spark, DIR).limit(5)
    for f in (search.graph_search, search.search_hops, search.layered_search):
        with pytest.raises(ValueError):
            f(few, few, few, 10, 5)


def test_blocked_graph_equals_all_pairs(spark):
    points = points_of(spark)[:250]
    vectors = registry.vectors(spark, DIR).where("id < 250")
    for block in (16, 100, 1024):
        found: dict = {}
        for r in graph.shard_knn_graph(sharding.direct(vectors, 250), vectors, 6, block).collect():
            found[r.local_id, r.pos] = r.nbr_local
        for i in range(250):
            dist = ((points - points[i]) ** 2).sum(axis=1)
            assert [found[i, p] for p in range(6)] == [j for j in np.lexsort((np.arange(250), dist)) if j != i][:6]


def test_descent_and_robust_pruning(spark):
    vectors = registry.vectors(spark, DIR)
    shards = sharding.direct(vectors, 250)
    exact = {(r.shard, r.local_id, r.nbr_local) for r in graph.shard_knn_graph(shards, vectors, 8).collect()}
    rough = {(r.shard, r.local_id, r.nbr_local) for r in graph.descent_graph(shards, vectors, 8, 5).collect()}
    assert len(exact & rough) > 0.9 * len(exact)
    points = points_of(spark)
    wide = graph.shard_knn_graph(shards, vectors, 16).collect()
    lists: dict = {}
    for r in sorted(wide, key=lambda r: r.pos):
        lists.setdefault((r.shard, r.local_id), []).append(r.nbr_local)
    found: dict = {}
    for r in sorted(graph.robust_pruned(spark.createDataFrame(wide), graph.placed_vectors(shards, vectors), 6).collect(), key=lambda r: r.pos):
        found.setdefault((r.shard, r.local_id), []).append(r.nbr_local)
    for (s, i), candidates in lists.items():
        at = lambda x: points[250 * s + x]
        kept: list = []
        for c in candidates:
            if len(kept) < 6 and all(1.44 * ((at(k) - at(c)) ** 2).sum() > ((at(i) - at(c)) ** 2).sum() for k in kept):
                kept.append(c)
        assert found[s, i] == kept


def test_fixed_merge_fails_where_a_node_has_too_few(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 1), (2, 2)], "src long, dst long")
    assert graph.merge(edges, 1, fixed=True).count() == 2
    with pytest.raises(Exception, match="fewer than 2 neighbours at node 2"):
        graph.merge(edges, 2, fixed=True).collect()


def test_layers_are_nested(spark):
    members = layers.layer_members(sharding.direct(registry.vectors(spark, DIR), 250), [250, 40, 7]).collect()
    by = {(s, layer): {r.base_id for r in members if (r.shard, r.layer) == (s, layer)} for s in (0, 1) for layer in (0, 1, 2)}
    assert all(by[s, 2] < by[s, 1] < by[s, 0] and len(by[s, 2]) == 7 and len(by[s, 1]) == 40 for s in (0, 1))


def test_random_centres_lie_between_one_and_minus_one(spark):
    values = [x for r in kmeans.random_centres(spark, 5, 20).collect() for x in r.centroid]
    assert len(values) == 100 and min(values) < -0.8 and max(values) > 0.8 and max(map(abs, values)) <= 1


BROKER = [(1, 1000, 128, 32), (2, 2000, 128, 64), (3, 1500, 128, 32)]


def test_tasks_of_a_lost_node_are_taken_by_another(spark):
    deps = spark.createDataFrame([(1, 2), (9, 3)], "parent long, child long")
    tasks = spark.createDataFrame(BROKER, "id long, n long, d long, deg long")
    status = lambda s: {r.id: (r.status, r.node) for r in s.collect()}
    state = scheduling.scheduled(scheduling.submitted(tasks), deps, 0, 10_000_000)
    assert status(state) == {1: ("running", 0), 2: ("pending", None), 3: ("running", 0)}
    state = scheduling.released(state, 0)
    assert status(state) == {1: ("ready", None), 2: ("pending", None), 3: ("ready", None)}
    state = scheduling.scheduled(state, deps, 1, 10_000_000)
    state = scheduling.scheduled(scheduling.completed(state, [3, 1]), deps, 1, 10_000_000)
    assert status(state) == {1: ("completed", 1), 2: ("running", 1), 3: ("completed", 1)} and not scheduling.all_done(state)
    assert scheduling.all_done(scheduling.completed(scheduling.completed(state, [2]), [2]))
    assert [r.id for r in scheduling.admitted(tasks.where("id != 2"), 10_000_000).orderBy("slot").collect()] == [3, 1]


def test_simulation(spark, tmp_path):
    (tmp_path / "trace.csv").write_text("0,add,node0\n0,add,node1\n5000,remove,node0\n9000,add,node7\n")
    trace = scheduling.read_trace(spark, str(tmp_path))
    assert [tuple(r) for r in trace.orderBy("timestamp", "node").collect()] == [(0, "add", 0), (0, "add", 1), (5000, "remove", 0), (9000, "add", 7)]
    tasks = spark.createDataFrame([(i, 1_000_000, 8, 8) for i in range(4)], "id long, n long, d long, deg long")
    deps = spark.createDataFrame([(0, 2), (1, 3)], "parent long, child long")
    runs = [tuple(r) for r in scheduling.simulate(tasks, deps, trace, capacity=100_000_000).collect()]
    # a run takes 6.4 s and a node holds one: 0 is lost at 5 s and goes on at 7 s on node 1, which has ended 1
    assert sorted(runs, key=lambda r: (r[2], r[0])) == [(0, 0, 0, 5000, "interrupted"), (1, 1, 0, 7000, "completed"), (0, 1, 7000, 14000, "completed"), (3, 7, 9000, 16000, "completed"), (2, 1, 14000, 21000, "completed")]
    assert scheduling.simulate(tasks, deps, trace.limit(0)).count() == 0
    many = spark.createDataFrame([(i, 1_000_000, 128, 32) for i in range(100)], "id long, n long, d long, deg long")
    chain = spark.createDataFrame([(i, i + 10) for i in range(90)], "parent long, child long")
    runs = scheduling.simulate(many, chain, trace).collect()
    done = {r.id: r for r in runs if r.outcome == "completed"}
    assert len(done) == 100 and all(done[i].ended <= min(r.started for r in runs if r.id == i + 10) for i in range(90))


def test_sizing():
    assert sizing.plan_partitions(1000, 128, 32, 2, 1, 1) == (1, 1000)
    assert sizing.task_cost(1000, 128, 32) == (1000 * 128 * 4 + 1000 * 32 * 6, 1000 * 128 * 32)
    g = sizing.layer_geometry(10_000_000, 32, 4, 24)
    # the exact factor is 67.86: 67 leaves 33.2 at the top and 68 leaves 31.8
    assert (g["growth"], g["sizes"]) == (68, [10_000_000, 32 * 68 * 68, 32 * 68, 32])
    assert g["offsets"] == [0, 10_000_000, 10_147_968, 10_150_144] and g["translation_offsets"] == [0, 0, 147_968, 150_144]
    assert (g["rows"], g["translated"]) == (10_150_176, 150_176)
    # 3.16: four would leave 2.3 of 10 points, fewer than the degree
    assert sizing.layer_geometry(100, 10, 3, 24)["growth"] == 3
    assert sizing.layered_file_bytes(sizing.layer_geometry(100, 10, 3, 3), 3) == 8 * -(-4 * 3 * 140 // 8) + 2 * 8 * -(-4 * 40 // 8) + 8
    assert sizing.sample_room(10**9, 128, 100, 1) == min(8388608, int(((1 << 30) - 2000) / (516 * 1.15)))


@pytest.mark.parametrize("metric", ["l2sq", "ip", "cosine"])
def test_many_equal_vectors_go_by_id(spark, metric, monkeypatch):
    monkeypatch.setattr(knn, "ROWS", 37)
    monkeypatch.setattr(knn, "MOST_QUERIES", 3)
    rng = np.random.default_rng(2)
    points = rng.normal(size=(200, 5)).astype(np.float32)
    points[rng.permutation(200)[:120]] = points[7]
    vectors = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, vec array<float>").repartition(5)
    asked = spark.createDataFrame([(i, points[i].tolist()) for i in (0, 3, 7, 50, 90, 120, 150)], "qid long, qvec array<float>")
    found: dict = {}
    for r in sorted(knn.knn(vectors, asked, 12, metric).collect(), key=lambda r: r["rank"]):
        found.setdefault(r.qid, []).append(r.id)
    for q, mine in found.items():
        dist = knn._fine(points.astype(float), points[q].astype(float), metric)
        assert mine == np.lexsort((np.arange(200), np.round(dist, 12)))[:12].tolist()
    assert len(found) == 7 and knn.knn(vectors, asked.limit(0)).count() == 0 and knn.knn(vectors.limit(0), asked).count() == 0
    with pytest.raises(Exception, match="differ in length"):
        knn.knn(vectors, spark.createDataFrame([(1, [0.0, 1.0])], "qid long, qvec array<float>")).collect()


def test_shard_search_gathers_a_few_candidates_of_many_shards(spark, monkeypatch):
    met, exact = [], knn.exact
    monkeypatch.setattr(knn, "exact", lambda found, *more: met.append(found.count()) or exact(found, *more))
    vectors, asked = registry.vectors(spark, DIR), registry.asked(spark, DIR)
    found = knn.shard_search(sharding.direct(vectors, 20), vectors, asked)
    # each of the 25 shards has 10 best of its own
    assert met[0] <= (10 + knn.SPARE) * asked.count()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, knn.knn(vectors, asked).collect()))


@pytest.mark.parametrize("size", [1, 7, 60, 300])
def test_shard_search_with_equal_and_repeated_vectors(spark, size, monkeypatch):
    monkeypatch.setattr(knn, "MOST_QUERIES", 3)
    rng = np.random.default_rng(size)
    points = rng.integers(0, 4, (200, 3)).astype(np.float32)
    points[rng.permutation(200)[:90]] = points[7]
    vectors = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, vec array<float>").repartition(5)
    asked = spark.createDataFrame([(i, points[i].tolist()) for i in (0, 3, 7, 50, 90)], "qid long, qvec array<float>")
    # every vector lies in up to three shards, some of them twice in one
    shards = spark.createDataFrame([(int(s), i) for i in range(200) for s in rng.integers(0, 200 // size + 1, 3)], "shard long, global_id long")
    found: dict = {}
    for r in sorted(knn.shard_search(shards, vectors, asked, 12).collect(), key=lambda r: r["rank"]):
        found.setdefault(r.qid, []).append((r.id, r.dist))
    for q in (0, 3, 7, 50, 90):
        dist = ((points.astype(float) - points[q]) ** 2).sum(axis=1)
        assert found[q] == [(i, dist[i]) for i in np.lexsort((np.arange(200), dist))[:12]]
    assert knn.shard_search(shards, vectors, asked.limit(0)).count() == 0 and knn.shard_search(shards.limit(0), vectors, asked).count() == 0


def test_gathered_vectors_are_the_best_in_whatever_parts_they_come(monkeypatch):
    monkeypatch.setattr(knn, "ELEMENTS", 40)
    monkeypatch.setattr(knn, "WAITING", 30)
    rng = np.random.default_rng(4)
    x, q = rng.integers(0, 5, (400, 2)).astype(float), rng.integers(0, 5, (6, 2)).astype(float)
    x[5], x[300] = np.nan, np.inf
    ids = rng.permutation(400)
    for most in (3, 18, 500):
        best = knn.Gathered(q, most)
        for part in np.split(rng.permutation(np.r_[np.arange(400), np.arange(100)]), [1, 2, 40, 41, 300]):
            best.search(x[part], ids[part])
        best.settle()
        for row in range(6):
            order = np.lexsort((ids, ((x - q[row]) ** 2).sum(axis=1)))[:most]
            assert best.near[best.rows == row].tolist() == ids[order].tolist()


def test_shard_search_with_distances_that_differ_in_the_last_digit(spark):
    rng = np.random.default_rng(1)
    one = rng.random(24)
    points = [rng.permutation(one).tolist() for _ in range(300)]
    vectors = spark.createDataFrame(list(enumerate(points)), "id long, vec array<double>")
    asked = spark.createDataFrame([(0, [0.0] * 24)], "qid long, qvec array<double>")
    found = knn.shard_search(sharding.direct(vectors, 50), vectors, asked).orderBy("rank").collect()
    # sums from left to right, of which many are the same but for rounding
    dist = [list(accumulate(x * x for x in p))[-1] for p in points]
    assert len(set(dist)) > 1 and [r.id for r in found] == sorted(range(300), key=lambda i: (dist[i], i))[:10]
