"""From vectors to shards in one call: plan, sample, seed, cluster, assign."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.functions import sizing
from vecspark.operators import kmeans, sharding
from vecspark.plans.lineage import cut


class Partitioned(NamedTuple):
    """centres(shard, centroid), assigned(id, shard, dist, home), shards(shard, local_id, global_id) and the plan."""

    centres: DataFrame
    assigned: DataFrame
    shards: DataFrame
    plan: dict


def clustered(vectors: DataFrame, k: int, rate: float, rounds: int, seed: int = 0) -> DataFrame:
    """k centres of a seeded sample of vectors, k-means++ and Lloyd; all vectors where the sample has fewer than k."""
    sample = cut(kmeans.seeded_sample(vectors.select("id", "vec"), rate, seed))
    if sample.count() < k:
        sample = vectors.select("id", "vec")
    return kmeans.lloyd(sample, kmeans.plus_plus(sample, k, seed), rounds)


def partition(vectors: DataFrame, degree: int, replicas: int, gib: float, epsilon: float, rate: float = 0.05, rounds: int = 10, least: int = 0, width: int = 4, seed: int = 0) -> Partitioned:
    """Overlapping shards of vectors(id, vec) that can be built within a memory budget, by selective replication.

    least: shards at least, if the budget asks for fewer. Where one shard holds all, nothing is assigned.
    """
    n, dim = vectors.agg(F.count("*"), F.max(F.size("vec"))).first()
    if not n:
        raise ValueError("no vectors")
    parts, limit = sizing.plan_partitions(n, dim, degree, replicas, gib, width)
    parts = max(parts, least)
    sample, rate = sizing.sample_size(n, parts, rate)
    centres = clustered(vectors, parts, rate, rounds, seed)
    assigned = cut(sharding.two_round(vectors, centres, min(replicas, parts), limit, epsilon))
    return Partitioned(centres, assigned, sharding.local_ids(assigned), {"parts": parts, "limit": limit, "sample": sample, "rate": rate})


def fitting_partition(vectors: DataFrame, degree: int, replicas: int, gib: float, rounds: int = 15, width: int = 4, seed: int = 0) -> Partitioned:
    """The plain baseline: 3, 5, 7 and more shards of the nearest `replicas` centres, until the largest, as estimated by
    a second sample, can be built within the budget. Sizes are not bounded after that."""
    n, dim = vectors.agg(F.count("*"), F.max(F.size("vec"))).first()
    if not n:
        raise ValueError("no vectors")
    rate = min(1.0, 256_000 / n)
    test = cut(kmeans.seeded_sample(vectors.select("id", "vec"), rate, seed + 1))
    parts = 3
    while True:
        centres = clustered(vectors, parts, rate, rounds, seed)
        largest = sharding.estimated_sizes(test, centres, replicas, rate).agg(F.max("n")).first()[0] or 0
        if sizing.index_bytes(largest, dim, degree, width) <= gib * sizing.GIB:
            break
        if parts >= n:
            raise ValueError("no number of shards fits the budget")
        parts += 2
    assigned = cut(sharding.nearest(vectors, centres, min(replicas, parts)).select("id", "shard", "dist", (F.col("rank") == 1).alias("home")))
    return Partitioned(centres, assigned, sharding.local_ids(assigned), {"parts": parts, "limit": None, "sample": int(rate * n), "rate": rate})
