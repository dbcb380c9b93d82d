"""Layered graphs: nested seeded samples of a shard, each with its own neighbour graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecspark.operators.graph import shard_knn_graph


def layer_members(shards: DataFrame, sizes: list[int], seed: int = 0) -> DataFrame:
    """(shard, layer, local, base_id) of shards(shard, local_id, global_id): layer l has sizes[l] of a shard's vectors.

    A layer holds the first of a seeded order of the shard, so it lies within the layer below; layer 0 is all of the
    shard, whatever its size. local is a vector's place in its layer by base_id, on layer 0 its local id.
    """
    seeded = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("global_id").cast("string")))
    ordered = shards.withColumn("_at", F.row_number().over(W.partitionBy("shard").orderBy(seeded, "global_id")))
    upper = F.filter(F.array(*[F.when(F.col("_at") <= n, F.lit(layer)) for layer, n in enumerate(sizes) if layer]), lambda x: x.isNotNull())
    rows = ordered.select("shard", F.col("global_id").alias("base_id"), "local_id", F.explode(F.concat(F.array(F.lit(0)), upper) if len(sizes) > 1 else F.array(F.lit(0))).alias("layer"))
    place = F.row_number().over(W.partitionBy("shard", "layer").orderBy("base_id")) - 1
    return rows.withColumn("_place", place).select("shard", "layer", F.when(F.col("layer") == 0, F.col("local_id")).otherwise(F.col("_place")).cast("long").alias("local"), "base_id")


def layered_graph(shards: DataFrame, vectors: DataFrame, sizes: list[int], degree: int, seed: int = 0) -> DataFrame:
    """(shard, layer, local, base_id, nbrs): the members of all layers with their nearest neighbours in the layer."""
    members = layer_members(shards, sizes, seed)
    out = None
    for layer in range(len(sizes)):
        own = members.where(F.col("layer") == layer)
        graph = shard_knn_graph(own.select("shard", F.col("local").alias("local_id"), F.col("base_id").alias("global_id")), vectors, degree)
        lists = graph.groupBy("shard", F.col("local_id").alias("local")).agg(F.sort_array(F.collect_list(F.struct("pos", "nbr_local"))).alias("n"))
        lists = lists.select("shard", "local", F.transform("n", lambda x: x.nbr_local).alias("nbrs"))
        level = own.join(lists, ["shard", "local"], "left").select("shard", "layer", "local", "base_id", "nbrs")
        out = level if out is None else out.unionByName(level)
    return out


def layer_slice(layers: DataFrame, layer: int) -> DataFrame:
    """The rows of one layer."""
    return layers.where(F.col("layer") == layer)


def translation(layers: DataFrame) -> DataFrame:
    """(shard, layer, local, base_id) of the layers above the lowest, whose locals are no local ids of the shard."""
    return layers.where("layer > 0").select("shard", "layer", "local", "base_id")


def down(found: DataFrame, layers: DataFrame, layer: int) -> DataFrame:
    """found(shard, base_id, ...) with the local of each in a layer."""
    return found.join(layer_slice(layers, layer).select("shard", "base_id", "local"), ["shard", "base_id"])
