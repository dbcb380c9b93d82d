"""Build tasks on workers that come and go: which are ready, which fit, and what becomes of them.

Tasks are control data, one for each shard. Their state is a table (id, memory, work, status, node), and every
transition makes the next one; simulate() replays a trace of workers on the driver.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PENDING, READY, RUNNING, COMPLETED = "pending", "ready", "running", "completed"
#: Simulated milliseconds of a step, units of work in one, and where a simulation gives up.
TICK, WORK_IN_MS, TIMEOUT = 1000, 10_000, 100_000_000


def costed(tasks: DataFrame) -> DataFrame:
    """tasks(id, n, d, deg) with memory and work."""
    n, d, deg = F.col("n"), F.col("d"), F.col("deg")
    return tasks.withColumn("memory", n * d * 4 + n * deg * 6).withColumn("work", n * d * deg)


def ready(tasks: DataFrame, deps: DataFrame, done: DataFrame) -> DataFrame:
    """Tasks that are not done and wait for no other; done(id)."""
    waiting = deps.join(done.select(F.col("id").alias("parent")), "parent", "left_anti").select(F.col("child").alias("id"))
    return tasks.join(done, "id", "left_anti").join(waiting, "id", "left_anti")


def admitted(tasks: DataFrame, capacity: int, alpha: float = 0.9) -> DataFrame:
    """(slot, id): first fit in falling order of work, lower ids first, skipping what no longer fits."""
    room = int(capacity * alpha)
    ordered = costed(tasks).agg(F.sort_array(F.collect_list(F.struct((-F.col("work")).alias("w"), "id", "memory"))).alias("q"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("ids"))

    def step(a, x):
        fits = a.used + x.memory <= room
        return F.struct(F.when(fits, a.used + x.memory).otherwise(a.used).alias("used"), F.when(fits, F.concat(a.ids, F.array(x.id))).otherwise(a.ids).alias("ids"))

    return ordered.select(F.posexplode(F.aggregate("q", start, step, lambda a: a.ids)).alias("slot", "id")).select(F.col("slot").cast("long").alias("slot"), "id")


def submitted(tasks: DataFrame) -> DataFrame:
    """The state of new tasks(id, n, d, deg)."""
    return tasks.withColumns({"status": F.lit(PENDING), "node": F.lit(None).cast("int")})


def refreshed(state: DataFrame, deps: DataFrame) -> DataFrame:
    """Pending tasks whose parents are all completed become ready. A dependency on an unknown task counts for nothing."""
    left = state.where(F.col("status") != COMPLETED).select(F.col("id").alias("parent"))
    waiting = deps.join(left, "parent").select(F.col("child").alias("id")).distinct().withColumn("_waits", F.lit(True))
    now = state.join(waiting, "id", "left")
    free = (F.col("status") == PENDING) & F.col("_waits").isNull()
    return now.withColumn("status", F.when(free, READY).otherwise(F.col("status"))).drop("_waits")


def scheduled(state: DataFrame, deps: DataFrame, node: int, capacity: int, alpha: float = 0.9) -> DataFrame:
    """The state after a node has taken what fits of the ready tasks."""
    now = refreshed(state, deps)
    block = admitted(now.where(F.col("status") == READY).select("id", "n", "d", "deg"), capacity, alpha).select("id", F.lit(True).alias("_taken"))
    now = now.join(block, "id", "left")
    taken = F.col("_taken").isNotNull()
    return now.withColumns({"status": F.when(taken, RUNNING).otherwise(F.col("status")), "node": F.when(taken, F.lit(node)).otherwise(F.col("node"))}).drop("_taken")


def released(state: DataFrame, node: int) -> DataFrame:
    """The state after a node is gone: what ran on it is ready again."""
    lost = (F.col("status") == RUNNING) & (F.col("node") == node)
    return state.withColumns({"status": F.when(lost, READY).otherwise(F.col("status")), "node": F.when(lost, F.lit(None)).otherwise(F.col("node"))})


def completed(state: DataFrame, ids: Iterable[int]) -> DataFrame:
    """The state after these tasks have ended; ending twice changes nothing."""
    return state.withColumn("status", F.when(F.col("id").isin(*ids), COMPLETED).otherwise(F.col("status")))


def all_done(state: DataFrame) -> bool:
    return state.where(F.col("status") != COMPLETED).isEmpty()


def read_trace(spark, path: str) -> DataFrame:
    """(timestamp, action, node) of a file of lines like 0,add,node3."""
    rows = spark.read.schema("timestamp long, action string, name string").csv(path)
    return rows.select("timestamp", "action", F.regexp_extract("name", r"(\d+)$", 1).cast("int").alias("node"))


def simulate(tasks: DataFrame, deps: DataFrame, trace: DataFrame, capacity: int = 16_000_000_000, alpha: float = 0.9) -> DataFrame:
    """(id, node, started, ended, outcome): every run of a task under a trace(timestamp, action, node) of workers.

    Time moves in steps of a second. In each, workers come or go, runs that are over complete, and every idle worker, by
    number, takes the ready tasks that fit, those of most work first. A run ends with its worker and its task is ready
    again. outcome: completed, or interrupted, or running at the end, when all is done or the time is out. An empty
    trace runs nothing.
    """
    spark = tasks.sparkSession
    work = {r.id: (r.memory, r.work) for r in costed(tasks).select("id", "memory", "work").collect()}
    edges = [(r.parent, r.child) for r in deps.select("parent", "child").collect() if r.parent in work and r.child in work]
    events = sorted((r.timestamp, at, r.action, r.node) for at, r in enumerate(trace.collect()))
    parents: dict = {}
    for parent, child in edges:
        parents.setdefault(child, set()).add(parent)
    waiting, done, nodes, running, out, now = set(work), set(), set(), {}, [], 0
    while events and (len(done) < len(work) or running) and now <= TIMEOUT:
        while events and events[0][0] <= now and (event := events.pop(0)):
            _, _, action, node = event
            if action == "add":
                nodes.add(node)
            elif action == "remove":
                nodes.discard(node)
                for task in [t for t, run in running.items() if run[0] == node]:
                    out.append((task, node, running.pop(task)[1], now, "interrupted"))
                    waiting.add(task)
        for task in [t for t, run in running.items() if run[2] <= now]:
            node, started, _ = running.pop(task)
            out.append((task, node, started, now, "completed"))
            done.add(task)
        for node in sorted(nodes - {run[0] for run in running.values()}):
            free = int(capacity * alpha)
            for task in sorted((t for t in waiting if parents.get(t, set()) <= done), key=lambda t: (-work[t][1], t)):
                if work[task][0] <= free:
                    free -= work[task][0]
                    waiting.discard(task)
                    running[task] = (node, now, now + work[task][1] // WORK_IN_MS)
        now += TICK
        events = events or [(TIMEOUT + TICK + 1, 0, "", 0)]
    out += [(task, run[0], run[1], None, "running") for task, run in running.items()]
    return spark.createDataFrame(out, "id long, node int, started long, ended long, outcome string")
