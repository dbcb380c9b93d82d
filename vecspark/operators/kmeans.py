"""k-means as aggregations over a broadcast of at most `MOST_CENTRES` centres.

The centres are one row with an array, so a vector meets all of them in its scan: assigning shuffles nothing.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecspark.functions.distance import l2sq

MOST_CENTRES = 10_000
CENTRES = "shard int, centroid array<double>"


def seeded_share(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from a digest of the parts; the same on every run and in every engine."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def plain_share(*parts) -> float:
    """seeded_share of plain values."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) / (1 << 32)


def seeded_sample(rows: DataFrame, rate: float, seed: int = 0, key: str = "id") -> DataFrame:
    """The rows whose seeded digest falls below the rate; the same on every run."""
    return rows.where(seeded_share(seed, F.col(key)) < F.lit(float(rate)))


def sample_with_replacement(vectors: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """(draw, id, vec): seeded draws, of which several may take the same vector; ids are dense from 0."""
    n = vectors.count()
    draws = vectors.sparkSession.range(size if n else 0).select(F.col("id").alias("draw"), F.floor(seeded_share(seed, F.col("id")) * n).alias("id"))
    return draws.join(vectors.select("id", "vec"), "id").select("draw", "id", "vec")


def random_centres(spark, k: int, dim: int, seed: int = 0) -> DataFrame:
    """k centres with elements between -1 and 1."""
    at = F.sequence(F.lit(0), F.lit(dim - 1))
    return spark.range(k).select(F.col("id").cast("int").alias("shard"), F.transform(at, lambda i: 2 * seeded_share(seed, F.col("id"), i) - 1).alias("centroid"))


def centre_row(centres: DataFrame) -> DataFrame:
    """One row with all centres in order of their shards."""
    if centres.count() > MOST_CENTRES:
        raise ValueError(f"more than {MOST_CENTRES} centres")
    return centres.agg(F.sort_array(F.collect_list(F.struct("shard", "centroid"))).alias("_centres"))


def centre_choices(vectors: DataFrame, centres: DataFrame) -> tuple[DataFrame, Column]:
    """vectors beside the row of all centres, and the array of a vector's (dist, shard, at): at is a centre's place."""
    pairs = F.transform("_centres", lambda c, i: F.struct(l2sq(F.col("vec"), c.centroid).alias("dist"), c.shard.alias("shard"), i.alias("at")))
    return vectors.crossJoin(F.broadcast(centre_row(centres))), pairs


def centre_distances(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """(id, shard, dist) of every vector and centre(shard, centroid)."""
    met, pairs = centre_choices(vectors, centres)
    return met.select("id", F.explode(pairs).alias("p")).select("id", "p.shard", "p.dist")


def assign(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """(id, shard, dist): the nearest centre of each vector, the lowest on ties."""
    met, pairs = centre_choices(vectors, centres)
    return met.select("id", F.array_min(pairs).alias("p")).select("id", "p.shard", "p.dist")


def update(vectors: DataFrame, assigned: DataFrame, centres: DataFrame) -> DataFrame:
    """Mean vectors of the assignment; a centre without vectors becomes zero."""
    flat = assigned.select("id", "shard").join(vectors, "id").select("shard", F.posexplode("vec").alias("i", "x"))
    return _means(flat, centres)


def _means(flat: DataFrame, centres: DataFrame) -> DataFrame:
    """Centres from (shard, i, x)."""
    mean = flat.groupBy("shard", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    whole = mean.groupBy("shard").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s.m).alias("mean"))
    zero = F.transform("centroid", lambda _: F.lit(0.0))
    return centres.join(whole, "shard", "left").select("shard", F.coalesce("mean", zero).alias("centroid"))


def residual(vectors: DataFrame, assigned: DataFrame, centres: DataFrame) -> DataFrame:
    """One row: the sum of squared distances to the assigned centres."""
    joined = assigned.select("id", "shard").join(vectors, "id").join(F.broadcast(centres), "shard")
    return joined.agg(F.sum(l2sq(F.col("vec"), F.col("centroid"))).alias("residual"))


def lloyd_step(vectors: DataFrame, centres: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The centres after one round, and (id, shard, vec) of the assignment that made them. A scan of the vectors finds
    the nearest centre and sends the sums of each partition, so nothing but these is shuffled."""
    met, pairs = centre_choices(vectors, centres)
    own = met.select("id", F.array_min(pairs).alias("p"), "vec").select("id", "p.shard", "p.dist", "vec")
    return _means(own.select("shard", F.posexplode("vec").alias("i", "x")), centres), own


def lloyd(vectors: DataFrame, centres: DataFrame, rounds: int = 10, least_gain: float = 1e-5, simple: bool = False) -> DataFrame:
    """Centres after at most some rounds; stops when the residual falls by less than a share of itself.

    The residual is that of a round's assignment to its new centres, or, if simple, to the centres it started from.
    The centres of a round are collected: as many vectors as there are centres.
    """
    before, spark = None, vectors.sparkSession
    for _ in range(rounds):
        made, own = lloyd_step(vectors, centres)
        now_centres = spark.createDataFrame(made.collect(), CENTRES)
        if simple:
            now = own.agg(F.sum("dist")).first()[0] or 0.0
        else:
            near = own.join(F.broadcast(now_centres), "shard")
            now = near.agg(F.sum(l2sq(F.col("vec"), F.col("centroid")))).first()[0] or 0.0
        centres = now_centres
        if now < 1e-12 or (before is not None and (before - now) / now < least_gain):
            break
        before = now
    return centres


def plus_plus_step(vectors: DataFrame, chosen: DataFrame, share: float) -> DataFrame:
    """The vector at which the running sum of squared distances to the chosen centres reaches a share of the total.

    The sums run within ranges of ids first, so that no window covers all vectors.
    """
    near = assign(vectors, chosen).select("id", "dist", F.floor(F.col("id") / 4096).alias("block"))
    blocks = near.groupBy("block").agg(F.sum("dist").alias("d"))
    upto = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("d").over(upto), F.lit(0.0))).withColumn("total", F.sum("d").over(W.partitionBy()))
    run = W.partitionBy("block").orderBy("id").rowsBetween(W.unboundedPreceding, 0)
    reached = near.join(blocks, "block").withColumn("run", F.col("before") + F.sum("dist").over(run)).where(F.col("run") >= share * F.col("total"))
    return reached.agg(F.min("id").alias("id"))


def plus_plus(vectors: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k centres by k-means++: the first among all vectors, each next one where the running sum of squared distances
    to those before reaches a seeded share. A centre is collected when it is chosen."""
    spark, rows = vectors.sparkSession, vectors.select("id", "vec")
    n = rows.count()
    if not n:
        raise ValueError("no vectors to choose centres from")
    first = int(plain_share(seed, 0) * n)
    place = rows.select("id").orderBy("id").offset(first).limit(1).first()["id"]
    found = [list(map(float, rows.where(F.col("id") == place).first()["vec"]))]
    while len(found) < k:
        chosen = spark.createDataFrame(list(enumerate(found)), CENTRES)
        at = plus_plus_step(rows, chosen, plain_share(seed, len(found))).first()["id"]
        found.append(list(map(float, rows.where(F.col("id") == at).first()["vec"])))
    return spark.createDataFrame(list(enumerate(found)), CENTRES)
