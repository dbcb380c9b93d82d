"""Best-first graph search with a bounded pool: within shards, over one merged graph, and through layers.

The state of a query is sequential, so it runs in Arrow groups where a graph fits a task: a shard, bounded by the
assignment, meets a block of queries, and the best of all shards are gathered. A merged graph of a checked size is one
such shard for every block of queries. One beyond it is searched by search_hops(), where all queries take a hop at a
time as joins of frontier, edges and vectors.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.functions.distance import l2sq
from vecspark.operators.kmeans import seeded_share
from vecspark.operators.knn import top_k
from vecspark.plans.lineage import cut

#: Vectors and edges, in bytes, that one task holds; a larger merged graph is searched hop by hop.
TASK_BYTES = 1 << 30
FOUND = "qid long, id long, dist double, visited long, computed long"


def best_first(vecs: np.ndarray, keys: np.ndarray, edges: dict[int, np.ndarray], starts: np.ndarray, query: np.ndarray, pool: int) -> tuple[list, int, int]:
    """([(dist, key, place)], visited, computed): expands the closest unexpanded entry of the pool until none is left.

    places are rows of vecs, keys break ties. A start counts as visited once it is met as a neighbour, and is then
    computed again.
    """

    def far(at: np.ndarray) -> np.ndarray:
        step = vecs[at]
        step -= query
        step *= step
        return step.sum(axis=1)

    def entries(at: np.ndarray) -> list:
        return sorted(zip(far(at).tolist(), keys[at].tolist(), at.tolist(), strict=True))

    held = entries(starts)[:pool]
    visited, expanded, within = set(), set(), {x[2] for x in held}
    while (entry := next((x for x in held if x[2] not in expanded), None)) is not None:
        expanded.add(entry[2])
        new = [x for x in dict.fromkeys(edges.get(entry[2], ())) if x not in visited]
        visited.update(new)
        offered = np.array([x for x in new if x not in within], dtype=np.int64)
        if len(offered):
            held = list(heapq.merge(held, entries(offered)))[:pool]
            within = {x[2] for x in held}
    return held, len(visited), len(starts) + len(visited)


def seeded_starts(n: int, pool: int, seed: int) -> np.ndarray:
    """Rows where searches start: all of no more than pool rows, else as many in seeded order."""
    return np.arange(n) if n <= pool else np.sort(np.random.default_rng(seed).permutation(n)[:pool])


def _matrix(vec: pd.Series) -> np.ndarray:
    return np.stack(vec.to_numpy()).astype(np.float64)


def graph_search(vectors: DataFrame, edges: DataFrame, queries: DataFrame, k: int, pool: int, seed: int = 0, query_blocks: int = 8, translation: DataFrame | None = None) -> DataFrame:
    """(qid, rank, id, dist, visited, computed) over vectors(shard, id, vec), edges(shard, src, dst), queries(qid, qvec).

    Starts are `pool` ids of each shard in seeded order, all of them if there are no more. k must not exceed pool.
    translation(shard, id, global_id) names what was found in local ids; a vector found in several shards counts once.
    visited and computed are summed over the shards of a query. A query of which fewer than k are found has fewer rows.
    """
    if k > pool:
        raise ValueError("k exceeds the pool")
    nbrs = edges.groupBy("shard", F.col("src").alias("id")).agg(F.collect_set("dst").alias("nbrs"))
    shard_rows = vectors.join(nbrs, ["shard", "id"], "left")
    blocks = queries.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(query_blocks)).cast("int"))
    left = shard_rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    named = vectors.select(F.col("shard").alias("in_shard")).distinct()
    right = blocks.crossJoin(F.broadcast(named)).withColumnRenamed("block", "in_block")
    names = ["shard", *(x.split()[0] for x in FOUND.split(", "))]

    def search(base: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if base.empty or asked.empty:
            return pd.DataFrame(columns=names)
        base = base.sort_values("id")
        ids, vecs = base["id"].to_numpy(), _matrix(base["vec"])
        place = {i: at for at, i in enumerate(ids.tolist())}
        links = {at: np.sort([place[x] for x in n if x in place]) for at, n in enumerate(base["nbrs"]) if n is not None}
        starts, shard = seeded_starts(len(ids), pool, seed), base["shard"].iloc[0]
        out = []
        for q, v in zip(asked["qid"], asked["qvec"], strict=True):
            found, visited, computed = best_first(vecs, ids, links, starts, np.asarray(v, dtype=np.float64), pool)
            out += [(shard, q, i, d, visited, computed) for d, i, _ in found[:k]]
        return pd.DataFrame(out, columns=names)

    found = left.groupBy("shard", "block").cogroup(right.groupBy("in_shard", "in_block")).applyInPandas(search, f"shard long, {FOUND}")
    return gathered(found, k, translation)


def gathered(found: DataFrame, k: int, translation: DataFrame | None = None) -> DataFrame:
    """(qid, rank, id, dist, visited, computed): the k best of what shards found(shard, qid, id, dist, visited, computed)."""
    work = found.groupBy("qid", "shard").agg(F.max("visited").alias("v"), F.max("computed").alias("c"))
    work = work.groupBy("qid").agg(F.sum("v").alias("visited"), F.sum("c").alias("computed"))
    if translation is not None:
        found = found.join(translation.select("shard", "id", "global_id"), ["shard", "id"]).drop("id").withColumnRenamed("global_id", "id")
    best = found.groupBy("qid", "id").agg(F.min("dist").alias("dist"))
    return top_k(best, k).join(work, "qid").select("qid", "rank", "id", "dist", "visited", "computed")


def translated_search(shards: DataFrame, vectors: DataFrame, graph: DataFrame, queries: DataFrame, k: int, pool: int, seed: int = 0) -> DataFrame:
    """graph_search of shards(shard, local_id, global_id), which may overlap, by their graph(shard, local_id, nbr_local)."""
    shards = shards.select(F.col("shard").cast("long").alias("shard"), "local_id", "global_id")
    base = shards.join(vectors, shards["global_id"] == vectors["id"]).select("shard", F.col("local_id").alias("id"), "vec")
    edges = graph.select(F.col("shard").cast("long").alias("shard"), F.col("local_id").alias("src"), F.col("nbr_local").alias("dst"))
    return graph_search(base, edges, queries, k, pool, seed, translation=shards.withColumnRenamed("local_id", "id"))


def merged_search(vectors: DataFrame, edges: DataFrame, queries: DataFrame, k: int, pool: int, seed: int = 0, query_blocks: int = 8) -> DataFrame:
    """(qid, rank, id, dist, visited, computed) over one graph of all vectors(id, vec) by edges(src, dst).

    The graph goes to each block of queries if it has no more than TASK_BYTES, else the search goes hop by hop.
    """
    size = vectors.agg(F.sum(4 * F.size("vec") + 48)).first()[0] or 0
    if size + 16 * edges.count() > TASK_BYTES:
        return search_hops(vectors, edges, queries, k, pool, seed)
    one = F.lit(0).cast("long").alias("shard")
    return graph_search(vectors.select(one, "id", "vec"), edges.select(one, "src", "dst"), queries, k, pool, seed, query_blocks)


def search_hops(vectors: DataFrame, edges: DataFrame, queries: DataFrame, k: int, pool: int, seed: int = 0, width: int = 1, hops: int = 10_000) -> DataFrame:
    """merged_search for graphs of any size. In a hop every query expands its `width` closest unexpanded entries.

    A query's pool and visited ids are one row; frontier, edges and vectors are joined. With a width of 1 the results
    are those of a search one by one; a larger one takes fewer hops and computes more.
    """
    if k > pool:
        raise ValueError("k exceeds the pool")
    vectors, edges = vectors.select("id", "vec"), edges.select("src", "dst").distinct()
    n = vectors.count()
    few = vectors if n <= pool else vectors.orderBy(seeded_share(seed, F.col("id")), "id").limit(pool)
    entry = F.struct(l2sq(F.col("vec"), F.col("qvec")).alias("dist"), F.col("id"), F.lit(False).alias("done"))
    # starts: no more than the pool for each query
    first = queries.crossJoin(F.broadcast(few)).groupBy("qid").agg(F.first("qvec").alias("qvec"), F.sort_array(F.collect_list(entry)).alias("pool"))
    state = cut(first.withColumn("visited", F.array().cast("array<bigint>")).withColumn("computed", F.size("pool").cast("long")))
    for _ in range(hops):
        open_ = F.slice(F.filter("pool", lambda x: ~x.done), 1, width)
        chosen = state.withColumn("_next", F.transform(open_, lambda x: x.id))
        active = chosen.where(F.size("_next") > 0)
        if active.isEmpty():
            break
        met = active.select("qid", F.explode("_next").alias("src")).join(edges, "src").select("qid", F.col("dst").alias("id")).distinct()
        known = active.select("qid", "qvec", F.col("visited").alias("_visited"))
        new = met.join(known, "qid").where(~F.array_contains("_visited", F.col("id"))).join(vectors, "id")
        new = new.groupBy("qid").agg(F.sort_array(F.collect_list(entry)).alias("_new"))
        expanded = F.transform("pool", lambda x: F.struct(x.dist.alias("dist"), x.id.alias("id"), (x.done | F.array_contains("_next", x.id)).alias("done")))
        there = F.transform("pool", lambda x: x.id)
        fresh = F.filter(F.coalesce("_new", F.slice("pool", 1, 0)), lambda x: ~F.array_contains(there, x.id))
        added = F.transform(F.coalesce("_new", F.slice("pool", 1, 0)), lambda x: x.id)
        state = cut(
            chosen.join(new, "qid", "left").select(
                "qid", "qvec",
                F.slice(F.sort_array(F.concat(expanded, fresh)), 1, pool).alias("pool"),
                F.concat("visited", added).alias("visited"),
                (F.col("computed") + F.size(added)).alias("computed"),
            )
        )
    else:
        raise RuntimeError(f"search did not settle in {hops} hops")
    rows = state.select("qid", F.posexplode(F.slice("pool", 1, k)).alias("at", "x"), F.size("visited").cast("long").alias("visited"), "computed")
    return rows.select("qid", (F.col("at") + 1).cast("long").alias("rank"), "x.id", "x.dist", "visited", "computed")


def counters(found: DataFrame) -> DataFrame:
    """One row: queries, and visits and distance computations of all."""
    each = found.groupBy("qid").agg(F.max("visited").alias("v"), F.max("computed").alias("c"))
    return each.agg(F.count("*").alias("n_queries"), F.sum("v").alias("visited"), F.sum("c").alias("computed"))


def layered_search(layers: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, pool: int, seed: int = 0, query_blocks: int = 8) -> DataFrame:
    """(qid, rank, id, dist, visited, computed) through layers(shard, layer, local, base_id, nbrs) of vectors(id, vec).

    nbrs are locals of the layer; layer 0 is the whole shard. The top layer is searched from seeded starts that all
    queries share; what its pool holds are, by base_id, the starts in the layer below. Shards are searched one by one and
    gathered.
    """
    if k > pool:
        raise ValueError("k exceeds the pool")
    rows = layers.join(vectors.select(F.col("id").alias("base_id"), "vec"), "base_id").select(F.col("shard").cast("long").alias("shard"), "layer", "local", "base_id", "nbrs", "vec")
    blocks = queries.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(query_blocks)).cast("int"))
    left = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    named = rows.select(F.col("shard").alias("in_shard")).distinct()
    right = blocks.crossJoin(F.broadcast(named)).withColumnRenamed("block", "in_block")
    names = ["shard", *(x.split()[0] for x in FOUND.split(", "))]

    def search(base: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if base.empty or asked.empty:
            return pd.DataFrame(columns=names)
        levels = []
        for _, level in sorted(base.groupby("layer"), reverse=True):
            level = level.sort_values("local")
            ids, local = level["base_id"].to_numpy(), {x: at for at, x in enumerate(level["local"].tolist())}
            links = {at: np.array([local[x] for x in n if x in local], dtype=np.int64) for at, n in enumerate(level["nbrs"]) if n is not None}
            levels.append((ids, _matrix(level["vec"]), links, {i: at for at, i in enumerate(ids.tolist())}))
        shard, out = base["shard"].iloc[0], []
        top = seeded_starts(len(levels[0][0]), pool, seed)
        for q, v in zip(asked["qid"], asked["qvec"], strict=True):
            query, starts, visited, computed = np.asarray(v, dtype=np.float64), top, 0, 0
            for depth, (ids, vecs, links, places) in enumerate(levels):
                if depth:
                    starts = np.array([places[i] for _, i, _ in found if i in places], dtype=np.int64)
                found, more, work = best_first(vecs, ids, links, starts, query, pool)
                visited, computed = visited + more, computed + work
            out += [(shard, q, i, d, visited, computed) for d, i, _ in found[:k]]
        return pd.DataFrame(out, columns=names)

    found = left.groupBy("shard", "block").cogroup(right.groupBy("in_shard", "in_block")).applyInPandas(search, f"shard long, {FOUND}")
    return gathered(found, k)
