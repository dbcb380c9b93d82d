"""Neighbour graphs: building one for each shard, pruning, and merging them into a global one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecspark.functions.distance import l2sq
from vecspark.operators.kmeans import seeded_share
from vecspark.plans.lineage import cut

#: Vectors of a block: two blocks are compared by one task as a matrix product.
BLOCK = 1024
EDGES = "shard long, local_id long, nbr_local long, dist double"


def placed_vectors(shards: DataFrame, vectors: DataFrame) -> DataFrame:
    """(shard, local_id, vec) of shards(shard, local_id, global_id)."""
    return shards.join(vectors, shards["global_id"] == vectors["id"]).select(F.col("shard").cast("long").alias("shard"), "local_id", "vec")


def packed_blocks(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """(shard, block, blocks, ids, rows): blocks of consecutive local ids as binary; blocks: how many the shard has."""
    sizes = placed.groupBy("shard").agg((F.floor(F.max("local_id") / block) + 1).cast("int").alias("blocks"))
    keyed = placed.withColumn("block", F.floor(F.col("local_id") / block).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        order = np.argsort(table["local_id"].to_numpy())
        vec = table["vec"].combine_chunks()
        matrix = vec.flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1).astype(np.float64)
        columns = [[table["shard"][0].as_py()], [table["block"][0].as_py()], [table["local_id"].to_numpy()[order].tobytes()], [matrix[order].tobytes()]]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["shard", "block", "ids", "rows"])

    return keyed.groupBy("shard", "block").applyInArrow(pack, "shard long, block int, ids binary, rows binary").join(F.broadcast(sizes), "shard")


def nearest_in(x: np.ndarray, y: np.ndarray, own: np.ndarray, other: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, other id and squared distance of the k nearest rows of y to each of x, without pairs of one id.

    A matrix product finds candidates, a few more than k; the differences of these give distances and order.
    """
    rough = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T
    rough[own[:, None] == other[None, :]] = np.inf
    most = min(k + 8, rough.shape[1])
    at = np.argpartition(rough, most - 1, axis=1)[:, :most] if most < rough.shape[1] else np.tile(np.arange(rough.shape[1]), (len(x), 1))
    exact = ((x[:, None, :] - y[at]) ** 2).sum(axis=2)
    exact[own[:, None] == other[at]] = np.inf
    order = np.lexsort((other[at], exact), axis=1)[:, :k]
    at, exact = np.take_along_axis(at, order, 1), np.take_along_axis(exact, order, 1)
    row = np.repeat(np.arange(len(x)), at.shape[1])
    real = np.isfinite(exact.ravel())
    return row[real], other[at.ravel()[real]], exact.ravel()[real]


def shard_knn_graph(shards: DataFrame, vectors: DataFrame, degree: int, block: int = BLOCK) -> DataFrame:
    """(shard, local_id, pos, nbr_local): the exact nearest neighbours of each vector within its shard.

    Each two blocks of a shard meet in a row of their own, so that a large shard is many tasks, and return the best of
    each vector: `degree` rows for each vector and block rather than all pairs. For shards of very many vectors, of which
    the work is still the square, there is descent_graph().
    """
    packed = packed_blocks(placed_vectors(shards, vectors), block)
    left = packed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = packed.select("shard", F.col("block").alias("with"), F.col("ids").alias("other_ids"), F.col("rows").alias("other_rows"))
    met = left.join(right, ["shard", "with"]).select("shard", "ids", "rows", "other_ids", "other_rows")

    def compare(batches):
        for batch in batches:
            for shard, ids, rows, other_ids, other_rows in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                own, other = np.frombuffer(ids, np.int64), np.frombuffer(other_ids, np.int64)
                x, y = np.frombuffer(rows).reshape(len(own), -1), np.frombuffer(other_rows).reshape(len(other), -1)
                for at in range(0, len(own), 128):
                    row, nbr, dist = nearest_in(x[at : at + 128], y, own[at : at + 128], other, degree)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(row), shard)), pa.array(own[at : at + 128][row]), pa.array(nbr), pa.array(dist)],
                        names=["shard", "local_id", "nbr_local", "dist"],
                    )

    return ranked(met.mapInArrow(compare, EDGES), degree)


def ranked(edges: DataFrame, degree: int) -> DataFrame:
    """(shard, local_id, pos, nbr_local) of the `degree` nearest of edges(shard, local_id, nbr_local, dist)."""
    order = W.partitionBy("shard", "local_id").orderBy("dist", "nbr_local")
    kept = edges.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= degree)
    return kept.select("shard", "local_id", (F.col("pos") - 1).cast("long").alias("pos"), "nbr_local")


def descent_graph(shards: DataFrame, vectors: DataFrame, degree: int, rounds: int = 6, seed: int = 0) -> DataFrame:
    """(shard, local_id, pos, nbr_local): nearest neighbours by descent, approximate, in n * degree^2 pairs a round.

    From seeded random neighbours on, every vector meets the neighbours of its neighbours in either direction and keeps
    the nearest. A vector hands on at most 2 * degree of those that name it, in seeded order.
    """
    placed = cut(placed_vectors(shards, vectors))
    sizes = placed.groupBy("shard").agg(F.count("*").alias("n"))
    draws = placed.select("shard", "local_id").join(F.broadcast(sizes), "shard")
    draws = draws.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2 * degree))))
    start = draws.withColumn("nbr_local", F.floor(seeded_share(seed, F.col("shard"), F.col("local_id"), F.col("i")) * F.col("n")))
    now = _measured(start.select("shard", "local_id", "nbr_local"), placed, degree)
    for round_ in range(rounds):
        by_other = W.partitionBy("shard", "a").orderBy(seeded_share(seed, round_, F.col("a"), F.col("b")))
        back = now.select("shard", F.col("nbr_local").alias("a"), F.col("local_id").alias("b"))
        back = back.withColumn("r", F.row_number().over(by_other)).where(F.col("r") <= 2 * degree).drop("r")
        both = now.select("shard", F.col("local_id").alias("a"), F.col("nbr_local").alias("b")).union(back).distinct()
        steps = both.join(both.select("shard", F.col("a").alias("b"), F.col("b").alias("c")), ["shard", "b"])
        met = steps.select("shard", F.col("a").alias("local_id"), F.col("c").alias("nbr_local"))
        known = now.select("shard", "local_id", "nbr_local")
        now = _measured(met.union(known).union(both.select("shard", F.col("a").alias("local_id"), F.col("b").alias("nbr_local"))), placed, degree)
    return now


def _measured(pairs: DataFrame, placed: DataFrame, degree: int) -> DataFrame:
    """The `degree` nearest of (shard, local_id, nbr_local), on disk."""
    other = placed.select("shard", F.col("local_id").alias("nbr_local"), F.col("vec").alias("_other"))
    rows = pairs.where("local_id != nbr_local").distinct().join(placed, ["shard", "local_id"]).join(other, ["shard", "nbr_local"])
    return cut(ranked(rows.select("shard", "local_id", "nbr_local", l2sq(F.col("vec"), F.col("_other")).alias("dist")), degree))


def rank_pruned(graph: DataFrame, degree: int) -> DataFrame:
    """(shard, local_id, pos, nbr_local): the `degree` edges of each node with the fewest detours, of a graph of an
    intermediate degree.

    An edge x -> y at position p has a detour for each z with x -> z before p and z -> y before p. Ties go by position.
    """
    first = graph.select("shard", F.col("local_id").alias("x"), F.col("nbr_local").alias("z"), F.col("pos").alias("xz"))
    second = graph.select("shard", F.col("local_id").alias("z"), F.col("nbr_local").alias("y"), F.col("pos").alias("zy"))
    paths = first.join(second, ["shard", "z"]).withColumnRenamed("x", "local_id").withColumnRenamed("y", "nbr_local")
    detours = (
        graph.join(paths, ["shard", "local_id", "nbr_local"]).where((F.col("xz") < F.col("pos")) & (F.col("zy") < F.col("pos")))
        .groupBy("shard", "local_id", "nbr_local").agg(F.count("*").alias("_detours"))
    )
    order = W.partitionBy("shard", "local_id").orderBy(F.coalesce("_detours", F.lit(0)), "pos")
    left = graph.join(detours, ["shard", "local_id", "nbr_local"], "left").withColumn("_pos", F.row_number().over(order))
    return left.where(F.col("_pos") <= degree).select("shard", "local_id", (F.col("_pos") - 1).cast("long").alias("pos"), "nbr_local")


def robust_pruned(graph: DataFrame, placed: DataFrame, degree: int, alpha: float = 1.2) -> DataFrame:
    """(shard, local_id, pos, nbr_local): robust pruning of each node's candidates, nearest first: one is kept unless
    alpha times its distance to a kept one is no more than that to the node. Distances are Euclidean."""
    other = placed.select("shard", F.col("local_id").alias("nbr_local"), F.col("vec").alias("_other"))
    rows = graph.join(placed, ["shard", "local_id"]).join(other, ["shard", "nbr_local"])
    near = rows.select("shard", "local_id", F.struct(l2sq(F.col("vec"), F.col("_other")).alias("d"), F.col("nbr_local").alias("i"), F.col("_other").alias("v")).alias("c"))
    lists = near.groupBy("shard", "local_id").agg(F.sort_array(F.collect_list("c")).alias("cs"))  # a node's candidates: the graph's degree

    def step(kept, c):
        hidden = F.exists(kept, lambda k: alpha * alpha * l2sq(k["v"], c["v"]) <= c["d"])
        return F.when((F.size(kept) < degree) & ~hidden, F.concat(kept, F.array(c))).otherwise(kept)

    chosen = lists.select("shard", "local_id", F.posexplode(F.aggregate("cs", F.slice("cs", 1, 0), step)).alias("pos", "c"))
    return chosen.select("shard", "local_id", F.col("pos").cast("long").alias("pos"), F.col("c.i").alias("nbr_local"))


def random_graph(shards: DataFrame, degree: int, seed: int = 0) -> DataFrame:
    """(shard, local_id, pos, nbr_local): seeded random neighbours, with repeats, of each vector of shards."""
    sizes = shards.groupBy("shard").agg(F.count("*").alias("_n"))
    rows = shards.select("shard", "local_id").join(F.broadcast(sizes), "shard").withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(degree - 1))))
    drawn = F.floor(seeded_share(seed, F.col("shard"), F.col("local_id"), F.col("pos")) * F.col("_n"))
    return rows.select("shard", "local_id", F.col("pos").cast("long").alias("pos"), drawn.alias("nbr_local"))


def remap(graph: DataFrame, shards: DataFrame) -> DataFrame:
    """(src, dst) in global ids of graph(shard, local_id, nbr_local)."""
    own = shards.select("shard", "local_id", F.col("global_id").alias("src"))
    other = shards.select("shard", F.col("local_id").alias("nbr_local"), F.col("global_id").alias("dst"))
    return graph.join(own, ["shard", "local_id"]).join(other, ["shard", "nbr_local"]).select("src", "dst")


def union_edges(edges: DataFrame) -> DataFrame:
    """Distinct edges without loops."""
    return edges.where("src != dst").distinct()


def merge(edges: DataFrame, degree: int, seed: int = 0, fixed: bool = False) -> DataFrame:
    """(src, pos, dst): a seeded random subset of at most `degree` distinct neighbours of each node.

    fixed: every node must have as many; the query fails if one has fewer.
    """
    order = W.partitionBy("src").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("src").cast("string"), F.col("dst").cast("string"))))
    numbered = union_edges(edges).withColumn("pos", (F.row_number().over(order) - 1).cast("long"))
    if fixed:
        n = F.count("*").over(W.partitionBy("src"))
        enough = F.assert_true(F.col("_n") >= degree, F.concat(F.lit(f"fewer than {degree} neighbours at node "), F.col("src")))
        numbered = numbered.withColumn("_n", n).withColumn("pos", F.coalesce(enough.cast("long"), F.col("pos"))).drop("_n")
    return numbered.where(F.col("pos") < degree).select("src", "pos", "dst")


def merge_all(edges: DataFrame, degree: int, seed: int = 0) -> DataFrame:
    """(src, pos, dst): of all edges of a node, repeats included, a seeded random choice of at most `degree`.

    edges(src, dst, shard, pos) as remap_placed() gives them; a node with no more keeps its edges in their order.
    """
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in ("src", "dst", "shard", "pos")]))
    n = F.count("*").over(W.partitionBy("src"))
    rows = edges.withColumn("_n", n).withColumn("_key", F.when(F.col("_n") > degree, key))
    order = W.partitionBy("src").orderBy(F.col("_key"), "shard", "pos")
    kept = rows.withColumn("at", F.row_number().over(order)).where(F.col("at") <= degree)
    return kept.select("src", (F.col("at") - 1).cast("long").alias("pos"), "dst")


def remap_placed(graph: DataFrame, shards: DataFrame) -> DataFrame:
    """(src, dst, shard, pos) in global ids of graph(shard, local_id, pos, nbr_local)."""
    own = shards.select("shard", "local_id", F.col("global_id").alias("src"))
    other = shards.select("shard", F.col("local_id").alias("nbr_local"), F.col("global_id").alias("dst"))
    return graph.join(own, ["shard", "local_id"]).join(other, ["shard", "nbr_local"]).select("src", "dst", "shard", "pos")


def medoids(shards: DataFrame, vectors: DataFrame) -> DataFrame:
    """(shard, local_id, medoid): of each shard the vector nearest to the mean, the lowest on ties."""
    placed = shards.join(vectors, shards["global_id"] == vectors["id"]).select("shard", "local_id", "global_id", "vec")
    mean = placed.select("shard", F.posexplode("vec").alias("i", "x")).groupBy("shard", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    whole = mean.groupBy("shard").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s.m).alias("_mean"))
    far = placed.join(F.broadcast(whole), "shard").select("shard", F.struct(F.round(l2sq(F.col("vec"), F.col("_mean")), 9).alias("d"), "global_id", "local_id").alias("b"))
    return far.groupBy("shard").agg(F.min("b").alias("b")).select("shard", "b.local_id", F.col("b.global_id").alias("medoid"))


def entry_point(shard_medoids: DataFrame) -> DataFrame:
    """One row: the medoid of the last shard, where a search of the merged graph begins."""
    return shard_medoids.agg(F.max(F.struct("shard", "medoid")).alias("b")).select(F.col("b.medoid").alias("medoid"))


def node_shards(shards: DataFrame) -> DataFrame:
    """(global_id, n_shards, first_shard) of every node."""
    return shards.groupBy("global_id").agg(F.count("*").alias("n_shards"), F.min("shard").alias("first_shard"))


def node_places(shards: DataFrame) -> DataFrame:
    """(global_id, shard, local_id): where each node is, in order within each partition of nodes."""
    return shards.select("global_id", "shard", "local_id").repartition("global_id").sortWithinPartitions("global_id", "shard")


def edges_by_node(edges: DataFrame) -> DataFrame:
    """(src, nbrs): the neighbours of each node in order of pos."""
    rows = edges.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("pos", "dst"))).alias("n"))
    return rows.select("src", F.transform("n", lambda x: x.dst).alias("nbrs"))


def in_ranges(edges: DataFrame, parts: int) -> DataFrame:
    """edges(src, ...) in partitions of consecutive nodes, sorted within each: what files of a range are written from."""
    return edges.repartitionByRange(parts, "src").sortWithinPartitions("src", *[c for c in ("pos", "dst") if c in edges.columns])


def degree_stats(merged: DataFrame) -> DataFrame:
    """One row: nodes, edges and degrees."""
    return merged.groupBy("src").count().agg(
        F.count("*").alias("n_nodes"), F.sum("count").alias("n_edges"), F.min("count").alias("least"), F.max("count").alias("most")
    )


def label_medoids(vectors: DataFrame, shards: DataFrame) -> DataFrame:
    """(label, shard, medoid): of each label in each shard the vector nearest to their mean, lowest id on ties.

    vectors(id, vec, label). Means and distances are aggregates; no group is gathered.
    """
    placed = shards.join(vectors, shards["global_id"] == vectors["id"]).select("label", "shard", "id", "vec")
    flat = placed.select("label", "shard", "id", F.posexplode("vec").alias("i", "x"))
    mean = flat.groupBy("label", "shard", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    far = flat.join(mean, ["label", "shard", "i"]).groupBy("label", "shard", "id").agg(F.round(F.sum((F.col("x") - F.col("m")) * (F.col("x") - F.col("m"))), 9).alias("d"))
    return far.groupBy("label", "shard").agg(F.min(F.struct("d", "id")).alias("b")).select("label", "shard", F.col("b.id").alias("medoid"))


def medoids_of_labels(given: DataFrame, shards: DataFrame) -> DataFrame:
    """(label, medoids): the given medoids (shard, label, local_id) of each label in global ids, in order of shards."""
    named = given.join(shards, ["shard", "local_id"]).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("shard", "global_id"))).alias("m"))
    return named.select("label", F.transform("m", lambda x: x.global_id).alias("medoids"))
