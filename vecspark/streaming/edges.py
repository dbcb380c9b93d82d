"""Edges of shards as they arrive: an incremental batch over a folder of shard graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.operators.graph import remap
from vecspark.sources.graphs import fixed_header
from vecspark.sources.matrices import file_size, read_segments
from vecspark.sources.vectors import shard_folders

SCHEMA = "shard bigint, local_id bigint, pos bigint, nbr_local bigint"


def ingest(spark: SparkSession, source: str, shards: DataFrame, target: str, checkpoint: str) -> None:
    """Append the remapped edges of shard graphs that are new in source; each file is taken once.

    A batch that is tried again replaces what it wrote before.
    """

    def append(batch: DataFrame, epoch: int) -> None:
        remap(batch, shards).write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    stream = spark.readStream.schema(SCHEMA).parquet(source).writeStream.foreachBatch(append)
    stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def arrived_shards(spark: SparkSession, folder: str, name: str, work: str) -> int:
    """Hand the graphs of shards whose build has ended on to the stream; how many have arrived so far.

    partition<i>/build.done says so. A shard's graph goes to work/arrived/ as one write, which readers see when it is
    whole; one that is there already is left alone.
    """
    come = 0
    for shard in range(len(shard_folders(folder, "idmap.ibin"))):
        home = f"{folder}/partition{shard}"
        if file_size(f"{home}/build.done") < 0:
            continue
        come += 1
        target = f"{work}/arrived/shard-{shard}"
        if file_size(f"{target}/_SUCCESS") < 0:
            found = read_segments(spark, [fixed_header(f"{home}/index/{name}", part=shard)], "<u4")
            rows = found.select(F.col("part").alias("shard"), F.col("id").alias("local_id"), F.posexplode("vec").alias("p", "nbr_local"))
            rows.select("shard", "local_id", F.col("p").cast("long").alias("pos"), "nbr_local").write.mode("overwrite").parquet(target)
    return come
