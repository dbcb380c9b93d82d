"""Assignment of vectors to overlapping, size-bounded shards.

Capacity rules are greedy by id: a lower id has priority at every shard. As all shards share that priority, the
result is the stable one, which set-wise waves reach as well: every vector proposes to its best shards that have
not refused it, every shard keeps the lowest ids up to its capacity and refuses the rest, until none is refused.

What a shard refuses are all ids above the last that it keeps, so that one id for each shard is the whole state of a
wave. A wave is a scan of the vectors' choices that counts proposals by shard and range of ids; only the range in which
a shard fills up is sorted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecspark.operators.kmeans import centre_choices
from vecspark.plans.lineage import cut

#: Ids of a range in which proposals are counted together.
RANGE = 1 << 16
NO_LIMIT = 2**63 - 1


def direct(vectors: DataFrame, size: int) -> DataFrame:
    """(shard, local_id, global_id): blocks of `size` consecutive ids."""
    return vectors.select(F.expr(f"id div {int(size)}").alias("shard"), (F.col("id") % size).alias("local_id"), F.col("id").alias("global_id"))


def nearest(vectors: DataFrame, centres: DataFrame, replicas: int) -> DataFrame:
    """(id, shard, dist, rank) of the nearest shards of each vector, without capacities."""
    met, pairs = centre_choices(vectors, centres)
    some = F.posexplode(F.slice(F.sort_array(pairs), 1, replicas)).alias("i", "p")
    return met.select("id", some).select("id", "p.shard", "p.dist", (F.col("i") + 1).cast("long").alias("rank"))


def choices(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """(id, choices): each vector's centres as (dist, shard, at), nearest first, on disk."""
    met, pairs = centre_choices(vectors, centres)
    return cut(met.select("id", F.sort_array(pairs).alias("choices")))


Rule = Callable[[Column, Callable[[Column], Column]], Column]


def waves(table: DataFrame, caps: list[int], rule: Rule, rounds: int = 1000) -> DataFrame:
    """(id, shard, dist, at, forced) of table(id, choices, ...): the stable assignment.

    caps: of each shard by its place. rule: an array of (dist, shard, at, forced) that a vector asks for, of its choices
    and of whether a choice has refused it; it must not take back what it asked for when more have refused. What is
    forced takes no place. Ids are unique. The driver holds one id for each shard.
    """
    spark, last = table.sparkSession, [NO_LIMIT if cap > 0 else -(2**63) for cap in caps]
    limits = spark.createDataFrame(list(enumerate(map(int, caps))), "at int, cap long")
    for _ in range(rounds):
        state = spark.createDataFrame([(last,)], "_last array<bigint>")
        asked = table.crossJoin(F.broadcast(state)).select("id", F.explode(rule(F.col("choices"), lambda c: F.col("id") > F.get(F.col("_last"), c["at"]))).alias("c"))
        counted = asked.where("not c.forced").select(F.col("c.at").alias("at"), "id", F.floor(F.col("id") / RANGE).alias("_range"))
        ranges = counted.groupBy("at", "_range").agg(F.count("*").alias("n")).join(F.broadcast(limits), "at")
        upto = W.partitionBy("at").orderBy("_range").rowsBetween(W.unboundedPreceding, 0)
        full = ranges.withColumn("upto", F.sum("n").over(upto)).where((F.col("upto") > F.col("cap")) & (F.col("upto") - F.col("n") <= F.col("cap")))
        full = spark.createDataFrame(full.select("at", "_range", (F.col("cap") - F.col("upto") + F.col("n")).alias("left")).collect(), "at int, _range long, left long")
        # one range for each shard: there is one row of it at most
        within = W.partitionBy("at").orderBy("id")
        edge = counted.join(F.broadcast(full), ["at", "_range"]).withColumn("place", F.row_number().over(within)).where(F.col("place") == F.col("left") + 1)
        refused = {r["at"]: r["id"] - 1 for r in edge.select("at", "id").collect()}
        if all(last[at] <= upto_id for at, upto_id in refused.items()):
            return asked.select("id", "c.shard", "c.dist", "c.at", "c.forced")
        last = [min(x, refused.get(at, NO_LIMIT)) for at, x in enumerate(last)]
    raise RuntimeError(f"assignment did not settle in {rounds} waves")


def _plain(cs: Column) -> Column:
    return F.transform(cs, lambda c: F.struct(c.dist.alias("dist"), c.shard.alias("shard"), c["at"].alias("at"), F.lit(False).alias("forced")))


def first_open(wanted: int) -> Rule:
    """The nearest shards that don't refuse."""
    return lambda cs, refused: _plain(F.slice(F.filter(cs, lambda c: ~refused(c)), 1, wanted))


def open_or_forced(wanted: int) -> Rule:
    """The nearest shards that don't refuse; if these are too few, all of them and the farthest of the full ones."""

    def rule(cs, refused):
        own, full = F.filter(cs, lambda c: ~refused(c)), F.filter(cs, refused)
        short = F.greatest(F.lit(0), F.lit(wanted) - F.size(own))
        last = F.slice(full, F.greatest(F.lit(1), F.size(full) - short + 1), short)
        forced = F.transform(last, lambda c: F.struct(c.dist.alias("dist"), c.shard.alias("shard"), c["at"].alias("at"), F.lit(True).alias("forced")))
        return F.concat(_plain(F.slice(own, 1, wanted)), forced)

    return rule


def within_average(wanted: int, epsilon: float) -> Rule:
    """Shards in order of distance that are within epsilon times the mean of those met so. A full one enters the mean,
    and then lifts the bound for the next."""

    def rule(cs, refused):
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("met"), F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("mean"), F.slice(_plain(cs), 1, 0).alias("taken"))

        def step(a, c):
            met = (a.n < wanted) & F.coalesce(c.dist <= epsilon * a["mean"], F.lit(True))
            total, count = a["sum"] + c.dist, a.met + 1
            taken = met & ~refused(c)
            return F.struct(
                F.when(taken, a.n + 1).otherwise(a.n).alias("n"),
                F.when(met, count).otherwise(a.met).alias("met"),
                F.when(met, total).otherwise(a["sum"]).alias("sum"),
                F.when(taken, total / count).when(~met, a["mean"]).alias("mean"),
                F.when(taken, F.concat(a.taken, _plain(F.array(c)))).otherwise(a.taken).alias("taken"),
            )

        return F.aggregate(cs, start, step, lambda a: a.taken)

    return rule


def _caps(centres: DataFrame, cap: int) -> list[int]:
    return [cap] * centres.count()


def _left(caps: list[int], taken: DataFrame) -> list[int]:
    used = {r["at"]: r["n"] for r in taken.groupBy("at").agg(F.count("*").alias("n")).collect()}
    return [cap - used.get(at, 0) for at, cap in enumerate(caps)]


def _fail_unless_total(vectors: int, room: int, what: str) -> None:
    if room < vectors:
        raise ValueError(f"{what}: room for {room} of {vectors}")


def two_round(vectors: DataFrame, centres: DataFrame, replicas: int, limit: int, epsilon: float, home_share: float = 0.8) -> DataFrame:
    """(shard, id, dist, home): selective replication.

    Round one gives every vector a home, the nearest shard with room within home_share of the limit; what finds none
    takes the nearest with room within the limit. All vectors have a home, or, where the shards have less room than
    there are vectors, ValueError is raised. Round two adds shards nearer than epsilon times the home and than 2 epsilon
    times the shard's radius, nearest first, while there is room and fewer than `replicas` shards. Distances are squared.
    """
    table, caps = choices(vectors, centres), _caps(centres, limit)
    n = table.count()
    _fail_unless_total(n, sum(caps), "no home for every vector")
    if len(caps) == 1:
        return table.select("id", F.col("choices")[0].alias("c")).select("id", "c.shard", "c.dist", F.lit(True).alias("home"))
    home = cut(waves(table, _caps(centres, int(home_share * limit)), first_open(1)))
    homeless = table.join(home.select("id"), "id", "left_anti")
    home = cut(home.union(waves(homeless, _left(caps, home), first_open(1))))
    found = home.select("id", "shard", "dist", F.lit(True).alias("home"))
    if replicas < 2:
        return found
    radius = {r["at"]: r["radius"] for r in home.groupBy("at").agg(F.max("dist").alias("radius")).collect()}
    wide = vectors.sparkSession.createDataFrame([([radius.get(at, 0.0) for at in range(len(caps))],)], "_radius array<double>")
    own = home.select("id", F.col("at").alias("_own"), F.col("dist").alias("_dist"))
    near = lambda c: (c["at"] != F.col("_own")) & (c.dist < epsilon * F.col("_dist")) & (c.dist < 2 * epsilon * F.get(F.col("_radius"), c["at"]))
    more = table.join(own, "id").crossJoin(F.broadcast(wide)).select("id", F.filter("choices", near).alias("choices"))
    added = waves(cut(more), _left(caps, home), first_open(replicas - 1))
    return found.union(added.select("id", "shard", "dist", F.lit(False)))


def non_selective(vectors: DataFrame, centres: DataFrame, replicas: int, limit: int) -> DataFrame:
    """(id, shard, dist): the `replicas` nearest shards with room for each vector.

    A full shard is taken, beyond the limit, when the shards left do not exceed the replicas still needed. So every
    vector has `replicas` shards, or all if there are fewer.
    """
    return waves(choices(vectors, centres), _caps(centres, limit), open_or_forced(replicas)).select("id", "shard", "dist")


def running_average(vectors: DataFrame, centres: DataFrame, replicas: int, limit: int, epsilon: float) -> DataFrame:
    """(id, shard, dist): shards in order of distance while one is within epsilon times the mean of those met, up to
    `replicas` with room. A full one enters the mean and then lifts the bound.

    Raises ValueError if the shards may leave a vector without any: they need room for `replicas` of every vector.
    """
    table, caps = choices(vectors, centres), _caps(centres, limit)
    _fail_unless_total(min(replicas, len(caps)) * table.count(), sum(caps), "no shard for every vector")
    return waves(table, caps, within_average(replicas, epsilon)).select("id", "shard", "dist")


def local_ids(assigned: DataFrame) -> DataFrame:
    """(shard, local_id, global_id): positions within the shard by ascending id."""
    order = W.partitionBy("shard").orderBy("id")
    return assigned.select("shard", (F.row_number().over(order) - 1).cast("long").alias("local_id"), F.col("id").alias("global_id"))


def stats(assigned: DataFrame) -> DataFrame:
    """(shard, n, radius) of an assignment."""
    return assigned.groupBy("shard").agg(F.count("*").alias("n"), F.max("dist").alias("radius"))


def report(assigned: DataFrame) -> DataFrame:
    """(shard, n, total, vectors, replication): sizes of shards, of all, and the mean number of shards of a vector."""
    vectors = assigned.agg(F.count_distinct("id").alias("vectors"))
    sizes = assigned.groupBy("shard").agg(F.count("*").alias("n"))
    whole = sizes.agg(F.sum("n").alias("total")).crossJoin(vectors).withColumn("replication", F.col("total") / F.col("vectors"))
    return sizes.crossJoin(F.broadcast(whole))


def running_distribution(homes: DataFrame, k: int, block: int) -> DataFrame:
    """(block, shard, share): after each block of ids the estimate of a shard's share of all vectors.

    It starts at 1 / k and moves by (old * (b + 1) + the block's share) / (b + 2) at block b from 0, which is
    (1 / k + the sum of the blocks' shares) / (b + 2).
    """
    rows = homes.select(F.expr(f"id div {int(block)}").alias("block"), "shard")
    sizes = rows.groupBy("block").agg(F.count("*").alias("whole"))
    cells = sizes.crossJoin(F.broadcast(homes.select("shard").distinct()))
    counts = rows.groupBy("block", "shard").agg(F.count("*").alias("n"))
    parts = cells.join(counts, ["block", "shard"], "left").withColumn("part", F.coalesce("n", F.lit(0)) / F.col("whole"))
    upto = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, 0)
    return parts.select("block", "shard", ((1.0 / k + F.sum("part").over(upto)) / (F.count("*").over(upto) + 1)).alias("share"))


def second_round_room(distribution: DataFrame, n: int, limit: int, home_share: float = 0.8) -> DataFrame:
    """(block, shard, room): places for replicas that an estimate leaves in a shard, no fewer than those kept free."""
    kept_free = limit - int(home_share * limit)
    return distribution.select("block", "shard", F.greatest(F.lit(kept_free), limit - F.floor(F.col("share") * n)).alias("room"))


def estimated_sizes(sample: DataFrame, centres: DataFrame, replicas: int, rate: float) -> DataFrame:
    """(shard, n): shard sizes of all vectors by those of a sample of a rate."""
    return nearest(sample, centres, replicas).groupBy("shard").agg(F.floor(F.count("*") / F.lit(float(rate))).alias("n"))
