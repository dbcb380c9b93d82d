"""Commands on files: python -m vecspark.cli COMMAND --help."""

from __future__ import annotations

import argparse
import json
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.operators import graph, knn, partitioning, search, sharding
from vecspark.plans.lineage import cut
from vecspark.sources import graphs, vectors
from vecspark.sources.matrices import create
from vecspark.streaming import edges as streaming

WIDTHS = {"fbin": 4, "fvecs": 4, "u8bin": 1, "bvecs": 1}


def element_bytes(path: str) -> int:
    suffix = vectors.suffix_of(path)
    if suffix not in WIDTHS:
        raise ValueError(f"{path}: vectors are {', '.join(WIDTHS)}")
    return WIDTHS[suffix]


def partition(spark: SparkSession, a) -> dict:
    """Overlapping shards within a memory budget."""
    base = vectors.read_vectors(spark, a.data_path)
    made = partitioning.partition(base, a.degree, a.replicas, a.memory, a.epsilon, a.sampling_rate, a.max_iteration, a.parts, element_bytes(a.data_path), a.seed)
    sizes = vectors.write_shards(made.shards, base, a.base_folder, vectors.suffix_of(a.data_path), made.centres)
    return made.plan | {"sizes": list(sizes.values())}


def fitting_partition(spark: SparkSession, a) -> dict:
    """Shards of the nearest centres, as many as make the largest fit."""
    base = vectors.read_vectors(spark, a.data_path)
    made = partitioning.fitting_partition(base, a.degree, a.replicas, a.memory, 15, element_bytes(a.data_path), a.seed)
    sizes = vectors.write_shards(made.shards, base, a.base_folder, vectors.suffix_of(a.data_path), made.centres)
    return made.plan | {"sizes": list(sizes.values())}


def direct_partition(spark: SparkSession, a) -> dict:
    """Shards of consecutive vectors."""
    base = vectors.read_vectors(spark, a.data_path)
    sizes = vectors.write_shards(sharding.direct(base, a.shard_size), base, a.base_folder, vectors.suffix_of(a.data_path))
    return {"sizes": list(sizes.values())}


def build(spark: SparkSession, a) -> dict:
    """A graph of fixed degree for each shard."""
    began = time.time()
    shards = cut(vectors.read_shards(spark, a.base_folder, a.suffix))
    placed, base = shards.drop("vec"), shards.select(F.col("global_id").alias("id"), "vec").dropDuplicates(["id"])
    least = shards.groupBy("shard").agg(F.count("*").alias("n")).agg(F.min("n")).first()[0] or 0
    if least <= a.degree:
        raise ValueError(f"a shard of {least} vectors has no {a.degree} neighbours for each")
    made = graph.shard_knn_graph(placed, base, min(a.intermediate, least - 1)) if not a.random else graph.random_graph(placed, a.degree, a.seed)
    made = cut(made if a.random else graph.rank_pruned(cut(made), a.degree))
    graphs.write_shard_graphs(made, a.base_folder, a.index_name, a.degree)
    text = f"seconds {time.time() - began:.3f}\nvectors {shards.count()}\nedges {made.count()}\n".encode()
    create(f"{a.base_folder}/build_time.txt", text, len(text))
    return {"degree": a.degree}


def merge(spark: SparkSession, a) -> dict:
    """The graphs of all shards as one of fixed degree."""
    placed = vectors.read_id_maps(spark, a.base_folder)
    local = graphs.read_shard_graphs(spark, a.base_folder, a.index_name)
    merged = cut(graph.merge(graph.remap(local, placed), a.degree, a.seed, fixed=True))
    path = f"{a.base_folder}/merged_index/{a.index_name}"
    graphs.write_fixed_graph(merged, path, a.degree)
    return {"index": path, "edges": merged.count()}


def variable_merge(spark: SparkSession, a) -> dict:
    """The graphs of all shards as one of varying degree, with medoids; the last shard's is the entry point."""
    shards = vectors.read_shards(spark, a.base_folder, a.suffix)
    placed, base = shards.drop("vec"), shards.select(F.col("global_id").alias("id"), "vec").dropDuplicates(["id"])
    if a.variable_shards:
        local, starts = graphs.read_variable_shards(spark, a.base_folder, a.index_name)
        found = starts.join(placed, ["shard", "local_id"]).select("shard", F.col("global_id").alias("medoid"))
    else:
        local, found = graphs.read_shard_graphs(spark, a.base_folder, a.index_name), graph.medoids(placed, base).select("shard", "medoid")
    medoids = [r.medoid for r in found.orderBy("shard").collect()]
    merged = cut(graph.merge(graph.remap(local, placed), a.degree, a.seed))
    path = f"{a.base_folder}/merged_index/{a.index_name}"
    n = placed.agg(F.max("global_id")).first()[0] + 1
    graphs.write_variable_graph(merged, path, n, medoids[-1], a.degree)
    graphs.write_medoids(medoids, f"{a.base_folder}/merged_index/medoids.bin")
    return {"index": path, "edges": merged.count(), "medoids": medoids}


def pipelined_merge(spark: SparkSession, a) -> dict:
    """Edges of the shards that are there so far, each taken once; the merged graph when all have come."""
    placed = vectors.read_id_maps(spark, a.base_folder)
    come = streaming.arrived_shards(spark, a.base_folder, a.index_name, f"{a.base_folder}/pipelined")
    streaming.ingest(spark, f"{a.base_folder}/pipelined/arrived/*", placed, f"{a.base_folder}/pipelined/edges", f"{a.base_folder}/pipelined/checkpoint")
    if come < a.nshards:
        return {"shards": come, "of": a.nshards}
    merged = cut(graph.merge(spark.read.parquet(f"{a.base_folder}/pipelined/edges").select("src", "dst"), a.degree, a.seed, fixed=True))
    path = f"{a.base_folder}/merged_index/{a.index_name}"
    graphs.write_fixed_graph(merged, path, a.degree)
    return {"shards": come, "of": a.nshards, "index": path, "edges": merged.count()}


def _evaluated(spark: SparkSession, a, found: DataFrame, began: float) -> dict:
    """Recall against the ground truth, work, and time over all queries."""
    found = cut(found)
    took = time.time() - began
    truth = graphs_truth(spark, a)
    worked = search.counters(found).first() if "visited" in found.columns else None
    out = {"recall": knn.recall(found, truth).first().recall, "queries": truth.select("qid").distinct().count(), "seconds": round(took, 3)}
    return out | ({"visited": worked.visited, "computed": worked.computed} if worked else {})


def graphs_truth(spark: SparkSession, a) -> DataFrame:
    return vectors.read_ground_truth(spark, a.truth).where(F.col("rank") <= a.k).select("qid", "id").distinct()


def search_merged(spark: SparkSession, a) -> dict:
    """Search of a merged graph of fixed or varying degree."""
    read = graphs.read_variable_graph if a.variable else graphs.read_fixed_graph
    links = graphs.exploded(read(spark, a.index)).select("src", "dst")
    base, asked = vectors.read_vectors(spark, a.data), vectors.read_queries(spark, a.query, a.data)
    began = time.time()
    find = search.search_hops if a.use_disk else search.merged_search
    return _evaluated(spark, a, find(base, links, asked, a.k, a.pool, a.seed), began)


def search_shards(spark: SparkSession, a) -> dict:
    """Search of every shard's graph, gathered; ids are translated by the shards' id maps."""
    asked, base = vectors.read_queries(spark, a.query, a.data), vectors.read_vectors(spark, a.data)
    placed, local = vectors.read_id_maps(spark, a.index_dir), graphs.read_shard_graphs(spark, a.index_dir, a.index_name)
    began = time.time()
    return _evaluated(spark, a, search.translated_search(placed, base, local, asked, a.k, a.pool, a.seed), began)


def search_layered(spark: SparkSession, a) -> dict:
    """Search through the layered files of shards of consecutive vectors."""
    asked, base = vectors.read_queries(spark, a.query, a.data), vectors.read_vectors(spark, a.data)
    n, rows = base.count(), None
    for shard, first in enumerate(range(0, n, a.shard_size)):
        own = min(a.shard_size, n - first)
        read = graphs.read_layered_graph(spark, f"{a.index_dir}/{a.pattern.format(shard)}", own, a.segment_size, a.layers, a.degree)
        read = read.select(F.lit(shard).cast("long").alias("shard"), "layer", "local", (F.col("base_id") + first).alias("base_id"), "nbrs")
        rows = read if rows is None else rows.unionByName(read)
    began = time.time()
    return _evaluated(spark, a, search.layered_search(rows, base, asked, a.k, a.pool, a.seed), began)


def convert(spark: SparkSession, a) -> dict:
    """A vector file as one of another type; its first rows, or all in seeded order."""
    if a.rows:
        vectors.head_rows(spark, a.source, a.target, a.rows)
    elif a.shuffle:
        vectors.shuffled_rows(spark, a.source, a.target, a.seed)
    else:
        vectors.converted(spark, a.source, a.target)
    return {"rows": vectors.header(a.target).rows}


#: Of each command: what it does, and its options as (names, type, default); no default: required.
DATA = [("--data-path", str), ("--base-folder", str)]
BUDGET = [("--memory", float), ("--degree", int), ("--replicas", int)]
SEARCH = [("--data", str), ("--query", str), ("--truth", str), ("--k", int), ("--pool", int)]
COMMANDS = {
    "partition": (partition, [*DATA, *BUDGET, ("--epsilon", float), ("--sampling-rate", float, 0.05), ("--max-iteration", int, 10), ("--parts", int, 1)]),
    "fitting-partition": (fitting_partition, [*DATA, *BUDGET]),
    "direct-partition": (direct_partition, [*DATA, ("--shard-size", int)]),
    "build": (build, [("--base-folder", str), ("--suffix", str), ("--index-name", str), ("--degree", int, 64), ("--intermediate", int, 128), ("--random", bool, False)]),
    "merge": (merge, [("--base-folder", str), ("--index-name", str), ("--degree", int)]),
    "variable-merge": (variable_merge, [("--base-folder", str), ("--suffix", str), ("--index-name", str), ("--degree", int), ("--variable-shards", bool, False)]),
    "pipelined-merge": (pipelined_merge, [("--base-folder", str), ("--index-name", str), ("--degree", int), ("--nshards", int)]),
    "search": (search_merged, [*SEARCH, ("--index", str), ("--variable", bool, False), ("--use-disk", bool, False)]),
    "search-shards": (search_shards, [*SEARCH, ("--index-dir", str), ("--index-name", str)]),
    "search-layered": (search_layered, [*SEARCH, ("--index-dir", str), ("--shard-size", int), ("--degree", int), ("--layers", int, 4), ("--segment-size", int, 32), ("--pattern", str, "part_{}.graph")]),
    "convert": (convert, [("--source", str), ("--target", str), ("--rows", int, 0), ("--shuffle", bool, False)]),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="vecspark", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    for name, (run, options) in COMMANDS.items():
        own = commands.add_parser(name, help=run.__doc__)
        for option, kind, *default in (*options, ("--seed", int, 0)):
            if kind is bool:
                own.add_argument(option, action="store_true")
            else:
                own.add_argument(option, type=kind, required=not default, default=default[0] if default else None)
    return out


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> dict:
    """Run a command and print what it returns as JSON."""
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("vecspark").getOrCreate()
    out = COMMANDS[a.command][0](spark, a)
    print(json.dumps(out))
    return out


if __name__ == "__main__":
    main()
