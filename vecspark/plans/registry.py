"""Queries over the fixture tables, by name, with their SQL twins.

Queries of a search are all vectors whose id is divisible by 100; they meet all vectors.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.functions import sizing
from vecspark.operators import graph, kmeans, knn, layers, scheduling, search, sharding
from vecspark.plans import oracles
from vecspark.plans.lineage import cut
from vecspark.plans.settings import (
    AVERAGED,
    CENTRES,
    DEGREE,
    EPSILON,
    FULL_POOL,
    LAYER_SIZES,
    MERGED,
    PLUS_PLUS,
    REPLICAS,
    ROOM,
    SHARD,
    TASK_CAPACITY,
)


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def asked(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).where(F.col("id") % 100 == 0).select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))


def centres(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).where(F.col("id") < CENTRES).select(F.col("id").cast("int").alias("shard"), F.col("vec").cast("array<double>").alias("centroid"))


def limit(spark: SparkSession, d: str, room: float) -> int:
    """Places of a shard where all shards together have `room` for every vector."""
    return ceil(room * vectors(spark, d).count() / CENTRES)


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return sharding.direct(vectors(spark, d), SHARD)


def overlapping(spark: SparkSession, d: str) -> DataFrame:
    return sharding.local_ids(sharding.nearest(vectors(spark, d), centres(spark, d), 2))


def shard_graph(spark: SparkSession, d: str) -> DataFrame:
    return graph.shard_knn_graph(blocks(spark, d), vectors(spark, d), DEGREE)


def overlapping_graph(spark: SparkSession, d: str) -> DataFrame:
    return graph.shard_knn_graph(overlapping(spark, d), vectors(spark, d), DEGREE)


def global_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.remap(shard_graph(spark, d), blocks(spark, d))


def merged(spark: SparkSession, d: str) -> DataFrame:
    """The graph that overlapping shards merge into."""
    return graph.merge(graph.remap(overlapping_graph(spark, d), overlapping(spark, d)), 2 * MERGED)


def beam(spark: SparkSession, d: str, pool: int) -> DataFrame:
    base = vectors(spark, d).select(F.expr(f"id div {SHARD}").alias("shard"), "id", "vec")
    edges = global_edges(spark, d).select(F.expr(f"src div {SHARD}").alias("shard"), "src", "dst")
    return search.graph_search(base, edges, asked(spark, d), 10, pool)


def searched(spark: SparkSession, d: str, pool: int) -> DataFrame:
    return search.merged_search(vectors(spark, d), merged(spark, d), asked(spark, d), 10, pool)


def hopped(spark: SparkSession, d: str, pool: int, width: int) -> DataFrame:
    return search.search_hops(vectors(spark, d), cut(merged(spark, d)), asked(spark, d), 10, pool, width=width)


def layered(spark: SparkSession, d: str) -> DataFrame:
    whole = sharding.direct(vectors(spark, d), 250)
    return layers.layered_graph(whole, vectors(spark, d), LAYER_SIZES, DEGREE)


def layered_found(spark: SparkSession, d: str, pool: int) -> DataFrame:
    return search.layered_search(layered(spark, d), vectors(spark, d), asked(spark, d), 10, pool)


def recall_of(found: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    return knn.recall(found, knn.knn(vectors(spark, d), asked(spark, d)))


def rounded(found: DataFrame, *more: str) -> DataFrame:
    return found.select("qid", "rank", "id", (F.round("dist", 9) + 0.0).alias("dist"), *more)


def tasks(spark: SparkSession, d: str) -> DataFrame:
    """A build task for each label: a thousand times its vectors."""
    sizes = vectors(spark, d).groupBy(F.col("label").cast("long").alias("id"), F.size("vec").cast("long").alias("d")).agg((F.count("*") * 1000).alias("n"))
    return sizes.select("id", "n", "d", F.lit(32).cast("long").alias("deg"))


def dependencies(spark: SparkSession, d: str) -> DataFrame:
    """Every task of the second five waits for the one five before it."""
    return tasks(spark, d).where("id >= 5").select((F.col("id") - 5).alias("parent"), F.col("id").alias("child"))


def first_tasks(spark: SparkSession, d: str) -> DataFrame:
    done = spark.createDataFrame([], "id long")
    return scheduling.admitted(scheduling.ready(tasks(spark, d), dependencies(spark, d), done), TASK_CAPACITY)


def task_states(spark: SparkSession, d: str) -> DataFrame:
    """After one node took tasks and is gone, another took some, and those of ids under 3 ended."""
    deps, state = dependencies(spark, d), scheduling.submitted(tasks(spark, d))
    state = scheduling.released(scheduling.scheduled(state, deps, 0, TASK_CAPACITY), 0)
    state = scheduling.completed(scheduling.scheduled(state, deps, 1, TASK_CAPACITY), [0, 1, 2])
    return scheduling.refreshed(state, deps).select("id", "status", "node")


def task_simulation(spark: SparkSession, d: str) -> DataFrame:
    trace = spark.createDataFrame([(0, "add", 0), (0, "add", 1), (9000, "remove", 0), (20000, "add", 2)], "timestamp long, action string, node int")
    return scheduling.simulate(tasks(spark, d), dependencies(spark, d), trace, TASK_CAPACITY)


def lloyd_counts(spark: SparkSession, d: str, simple: bool) -> DataFrame:
    v = vectors(spark, d)
    return kmeans.assign(v, kmeans.lloyd(v, centres(spark, d), 3, 0.0, simple)).groupBy("shard").agg(F.count("*").alias("n"))


def plus_plus(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    found = kmeans.plus_plus(v, PLUS_PLUS, 1)
    return v.join(F.broadcast(found), v["vec"].cast("array<double>") == found["centroid"]).select("shard", "id")


def two_round(spark: SparkSession, d: str) -> DataFrame:
    return sharding.two_round(vectors(spark, d), centres(spark, d), REPLICAS, limit(spark, d, ROOM["two_round"]), EPSILON)


def plans(spark: SparkSession, d: str) -> DataFrame:
    """What the sizes of the table and of 10,000 times it come to."""
    n, dim = vectors(spark, d).agg(F.count("*"), F.max(F.size("vec"))).first()
    rows = []
    for times in (1, 10_000):
        m = n * times
        parts, most = sizing.plan_partitions(m, dim, 64, 2, 0.5)
        sample, rate = sizing.sample_size(m, parts, 0.05)
        geometry = sizing.layer_geometry(m, 32, 4, 24)
        rows.append((times, parts, most, sample, rate, sizing.sample_room(m, dim, parts, 0.5), geometry["growth"], geometry["rows"], geometry["translated"]))
    return spark.createDataFrame(rows, "times long, parts long, most long, sample long, rate double, room long, growth long, layer_rows long, translated long")


HOME = lambda s, d: kmeans.assign(vectors(s, d), centres(s, d))

QUERIES = {
    "knn_exact_topk": lambda s, d: knn.knn(vectors(s, d), asked(s, d)),
    "knn_ip_topk": lambda s, d: knn.knn(vectors(s, d), asked(s, d), metric="ip"),
    "knn_cosine_topk": lambda s, d: rounded(knn.knn(vectors(s, d), asked(s, d), metric="cosine")),
    "knn_range_filter": lambda s, d: knn.knn(vectors(s, d), asked(s, d), where=F.col("id").between(100, 299)),
    "knn_within_label": lambda s, d: knn.knn(vectors(s, d), vectors(s, d).where("id % 100 = 0").selectExpr("id AS qid", "vec AS qvec", "label AS qlabel"), match=F.col("label") == F.col("qlabel")),
    "recall_at_k": lambda s, d: recall_of(knn.knn(vectors(s, d).where("id % 3 != 1"), asked(s, d)), s, d),
    "valid_results": lambda s, d: knn.valid(knn.knn(vectors(s, d), asked(s, d), 15), 300),
    "vectors_by_id": lambda s, d: knn.by_ids(vectors(s, d).select("id", "vec"), asked(s, d).select(F.col("qid").alias("id"))).select("id", F.posexplode("vec").alias("i", "x")).select("id", "i", F.col("x").cast("double").alias("x")),
    "shard_direct": blocks,
    "shard_direct_sizes": lambda s, d: blocks(s, d).groupBy("shard").agg(F.count("*").alias("n")),
    "shard_search_gather": lambda s, d: knn.shard_search(blocks(s, d), vectors(s, d), asked(s, d)),
    "sample_rows": lambda s, d: kmeans.seeded_sample(vectors(s, d), 0.3).select("id"),
    "sample_with_replacement": lambda s, d: kmeans.sample_with_replacement(vectors(s, d), 100).select("draw", "id"),
    "random_centres": lambda s, d: kmeans.random_centres(s, CENTRES, 4).select("shard", F.posexplode("centroid").alias("i", "x")).select("shard", "i", F.round("x", 9).alias("x")),
    "kmeans_assign": HOME,
    "kmeans_update": lambda s, d: kmeans.update(vectors(s, d), HOME(s, d), centres(s, d)).select("shard", F.posexplode("centroid").alias("i", "m")).select("shard", "i", F.round("m", 9).alias("m")),
    "kmeans_residual": lambda s, d: kmeans.residual(vectors(s, d), HOME(s, d), centres(s, d)).select(F.round("residual", 6).alias("residual")),
    "kmeans_lloyd_3": lambda s, d: lloyd_counts(s, d, False),
    "kmeans_lloyd_simple_3": lambda s, d: lloyd_counts(s, d, True),
    "kmeans_seed_step": lambda s, d: kmeans.plus_plus_step(vectors(s, d), centres(s, d), 0.4),
    "kmeans_plus_plus": plus_plus,
    "assign_nearest_k": lambda s, d: sharding.nearest(vectors(s, d), centres(s, d), 2),
    "assign_two_round": two_round,
    "assign_nonselective": lambda s, d: sharding.non_selective(vectors(s, d), centres(s, d), REPLICAS, limit(s, d, ROOM["nonselective"])),
    "assign_running_avg": lambda s, d: sharding.running_average(vectors(s, d), centres(s, d), AVERAGED, limit(s, d, ROOM["running_avg"]), EPSILON),
    "shard_stats": lambda s, d: sharding.stats(sharding.nearest(vectors(s, d), centres(s, d), 2)),
    "shard_home_radius": lambda s, d: sharding.stats(two_round(s, d).where("home")),
    "shard_report": lambda s, d: sharding.report(two_round(s, d)),
    "running_distribution": lambda s, d: sharding.running_distribution(HOME(s, d), CENTRES, 128).withColumn("share", F.round("share", 9)),
    "second_round_room": lambda s, d: sharding.second_round_room(sharding.running_distribution(HOME(s, d), CENTRES, 128), vectors(s, d).count(), limit(s, d, ROOM["two_round"])),
    "estimated_sizes": lambda s, d: sharding.estimated_sizes(kmeans.seeded_sample(vectors(s, d), 0.3), centres(s, d), 2, 0.3),
    "local_ids": overlapping,
    "shard_knn_graph": shard_graph,
    "graph_rank_pruned": lambda s, d: graph.rank_pruned(cut(graph.shard_knn_graph(blocks(s, d), vectors(s, d), 2 * DEGREE)), DEGREE),
    "graph_robust_pruned": lambda s, d: graph.robust_pruned(graph.shard_knn_graph(blocks(s, d), vectors(s, d), 2 * DEGREE), graph.placed_vectors(blocks(s, d), vectors(s, d)), DEGREE),
    "graph_descent": lambda s, d: graph.descent_graph(sharding.direct(vectors(s, d), 250), vectors(s, d), DEGREE, 4),
    "graph_random": lambda s, d: graph.random_graph(blocks(s, d), DEGREE),
    "graph_remap": global_edges,
    "graph_ranges": lambda s, d: graph.in_ranges(global_edges(s, d), 5),
    "graph_union": lambda s, d: graph.union_edges(global_edges(s, d)),
    "graph_merge_variable": lambda s, d: graph.merge(global_edges(s, d), MERGED),
    "graph_merge_overlapping": merged,
    "graph_merge_fixed": lambda s, d: graph.merge(global_edges(s, d), MERGED, fixed=True),
    "graph_merge_all": lambda s, d: graph.merge_all(graph.remap_placed(overlapping_graph(s, d), overlapping(s, d)), DEGREE),
    "graph_degree_stats": lambda s, d: graph.degree_stats(graph.merge(global_edges(s, d), MERGED)),
    "node_shard_map": lambda s, d: graph.node_shards(overlapping(s, d)),
    "node_places": lambda s, d: graph.node_places(overlapping(s, d)),
    "shard_medoids": lambda s, d: graph.medoids(blocks(s, d), vectors(s, d)),
    "entry_point": lambda s, d: graph.entry_point(graph.medoids(blocks(s, d), vectors(s, d))),
    "label_medoids": lambda s, d: graph.label_medoids(vectors(s, d), blocks(s, d)),
    "medoids_of_labels": lambda s, d: graph.medoids_of_labels(blocks(s, d).select("shard", (F.col("local_id") % 3).alias("label"), "local_id").where("local_id < 6"), blocks(s, d)).select("label", F.posexplode("medoids").alias("place", "medoid")),
    "beam_search_full_pool": lambda s, d: rounded(beam(s, d, FULL_POOL)),
    "beam_search_recall": lambda s, d: recall_of(beam(s, d, 32), s, d),
    "merged_search_full_pool": lambda s, d: rounded(searched(s, d, FULL_POOL), "visited", "computed"),
    "merged_search_recall": lambda s, d: recall_of(searched(s, d, 64), s, d),
    "merged_search_counters": lambda s, d: search.counters(searched(s, d, FULL_POOL)),
    "hop_search_full_pool": lambda s, d: rounded(hopped(s, d, FULL_POOL, FULL_POOL), "visited", "computed"),
    "translated_search_full_pool": lambda s, d: rounded(search.translated_search(overlapping(s, d), vectors(s, d), overlapping_graph(s, d), asked(s, d), 10, FULL_POOL)),
    "translated_search_recall": lambda s, d: recall_of(search.translated_search(overlapping(s, d), vectors(s, d), overlapping_graph(s, d), asked(s, d), 10, 32), s, d),
    "layer_members": lambda s, d: layers.layer_members(sharding.direct(vectors(s, d), 250), LAYER_SIZES),
    "layer_translation": lambda s, d: layers.down(layers.translation(layered(s, d)).where("layer = 2").select("shard", "base_id"), layered(s, d), 1),
    "layered_search_recall": lambda s, d: recall_of(layered_found(s, d, 64), s, d),
    "task_pack": first_tasks,
    "task_states": task_states,
    "task_simulation": task_simulation,
    "plan_partitions": plans,
}
ORACLES = oracles.ORACLES
