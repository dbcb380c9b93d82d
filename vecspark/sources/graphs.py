"""Graph files: neighbour lists of one degree, of varying degree, and in layers.

Fixed degree: a tag of four bytes, five numbers and the lists, each of them framed as a numpy array: version (i4), rows,
dim and degree (u4), metric (u2), u4[rows][degree]; a flag may follow. Varying degree: [u64 bytes][u32 widest]
[u32 entry point][u64 0], then [u32 n][n * u32] for each node. Layers: the lists of all layers, u4, from the lowest
layer on, then for each node above the lowest its id in the lowest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecspark.functions.sizing import layer_geometry, layered_file_bytes
from vecspark.sources.matrices import Segment, create, file_bytes, file_size, file_system, posix, read_segments, write_rows
from vecspark.sources.vectors import shard_folders

#: Fixed values of the format: the magic string, the length of a frame's header, the tag and the version.
MAGIC, FRAME, TAG, VERSION = b"\x93NUMPY", 118, b"<f4\x00", 4


def framed(kind: str, shape: tuple[int, ...] = ()) -> bytes:
    """The frame before a number or a matrix."""
    said = f"{{'descr': '{kind}', 'fortran_order': False, 'shape': ({','.join(map(str, shape))})}}"
    return MAGIC + b"\x01\x00" + FRAME.to_bytes(2, "little") + said.ljust(FRAME - 1).encode() + b"\n"


def fixed_head(rows: int, degree: int) -> bytes:
    numbers = (("<i4", VERSION), ("<u4", rows), ("<u4", 0), ("<u4", degree), ("<u2", 0))
    return TAG + b"".join(framed(kind) + np.array([x], kind).tobytes() for kind, x in numbers) + framed("<u4", (rows, degree))


def fixed_header(path: str, degree: int | None = None, part: int = 0) -> Segment:
    """Where the lists of a fixed-degree file are; ValueError if it is none, is short, or has another degree."""
    raw, at, found = file_bytes(path, 0, 4096), 4, []
    for kind in ("<i4", "<u4", "<u4", "<u4", "<u2", None):
        if raw[at : at + 6] != MAGIC:
            raise ValueError(f"{path}: no graph of fixed degree")
        at += 10 + int.from_bytes(raw[at + 8 : at + 10], "little")
        if kind:
            found.append(int(np.frombuffer(raw, kind, 1, at)[0]))
            at += np.dtype(kind).itemsize
    _, rows, _, own, _ = found
    if degree is not None and own != degree:
        raise ValueError(f"{path}: degree {own}, not {degree}")
    if file_size(path) < at + 4 * rows * own:
        raise ValueError(f"{path}: too short for {rows} lists of {own}")
    return Segment(path, at, rows, own, "<u4", part=part)


def read_fixed_graph(spark: SparkSession, path: str, degree: int | None = None) -> DataFrame:
    """(src, nbrs) of a graph of fixed degree."""
    return read_segments(spark, [fixed_header(path, degree)], "<u4").select(F.col("id").alias("src"), F.col("vec").alias("nbrs"))


def exploded(lists: DataFrame) -> DataFrame:
    """(src, pos, dst) of (src, nbrs)."""
    return lists.select("src", F.posexplode("nbrs").alias("p", "dst")).select("src", F.col("p").cast("long").alias("pos"), "dst")


def read_shard_graphs(spark: SparkSession, folder: str, name: str, degree: int | None = None) -> DataFrame:
    """(shard, local_id, pos, nbr_local) of partition<i>/index/<name>, which have one degree."""
    segments = [fixed_header(path, degree, shard) for shard, path in enumerate(shard_folders(folder, f"index/{name}"))]
    if len({s.dim for s in segments}) > 1:
        raise ValueError(f"{folder}: shards of different degree")
    rows = read_segments(spark, segments, "<u4").select("part", "id", F.posexplode("vec").alias("p", "nbr_local"))
    return rows.select(F.col("part").alias("shard"), F.col("id").alias("local_id"), F.col("p").cast("long").alias("pos"), "nbr_local")


def _lists(edges: DataFrame, keys: tuple[str, ...], other: str) -> DataFrame:
    """(keys, vec): neighbour lists in order of pos."""
    rows = edges.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", other))).alias("n"))
    return rows.select(*keys, F.transform("n", lambda x: x[other]).alias("vec"))


def write_fixed_graph(edges: DataFrame, path: str, degree: int) -> None:
    """edges(src, pos, dst) as a graph of fixed degree; every id from 0 to the highest must have as many neighbours."""
    lists = _lists(edges, ("src",), "dst").select(F.lit(0).cast("long").alias("part"), F.col("src").alias("pos"), "vec")
    _write_fixed(lists, {0: path}, degree)


def write_shard_graphs(graph: DataFrame, folder: str, name: str, degree: int) -> None:
    """graph(shard, local_id, pos, nbr_local) as a file for each shard."""
    lists = _lists(graph, ("shard", "local_id"), "nbr_local").select(F.col("shard").cast("long").alias("part"), F.col("local_id").alias("pos"), "vec")
    shards = [r["part"] for r in lists.select("part").distinct().collect()]
    _write_fixed(lists, {s: f"{folder}/partition{s}/index/{name}" for s in shards}, degree)


def _write_fixed(lists: DataFrame, paths: dict[int, str], degree: int) -> None:
    sizes = lists.groupBy("part").agg(F.count("*").alias("n"), F.max("pos").alias("last"), F.min(F.size("vec")).alias("least"), F.max(F.size("vec")).alias("most"))
    files = {}
    for r in sizes.collect():
        if r.n != r["last"] + 1 or r.least != degree or r.most != degree:
            raise ValueError(f"part {r.part}: ids must have no gap, and each {degree} neighbours")
        head = fixed_head(r.n, degree)
        flag = framed("|u1") + b"\x00"
        create(paths[r.part], head, len(head) + 4 * r.n * degree + len(flag), flag)
        files[r.part] = (paths[r.part], len(head), 4 * degree)
    if files:
        write_rows(lists.repartition("part").sortWithinPartitions("part", "pos"), files, "<u4")


def variable_lists(path: str):
    """The neighbour lists of a graph of varying degree, one after the other."""
    system, name = file_system(path)
    with system.open_input_stream(name, buffer_size=8 << 20) as f:
        size = int.from_bytes(f.read(8), "little")
        f.read(16)
        at = 24
        while at < size:
            n = int.from_bytes(f.read(4), "little")
            raw = f.read(4 * n)
            if len(raw) != 4 * n:
                raise ValueError(f"{path} ends within a list")
            yield np.frombuffer(raw, "<u4")
            at += 4 + 4 * n


def entry_point(path: str) -> int:
    """The node where a search of a graph of varying degree begins."""
    return int.from_bytes(file_bytes(path, 12, 4), "little")


def read_variable_graphs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(part, src, nbrs) of graphs of varying degree, a task for each: where a list begins depends on all before it."""

    def scan(batches):
        for batch in batches:
            for part in batch.column("id").to_pylist():
                lists, first = [], 0
                for nbrs in variable_lists(paths[part]):
                    lists.append(nbrs.astype(np.int64))
                    if len(lists) == 4096:
                        yield out(part, first, lists)
                        first, lists = first + len(lists), []
                if lists:
                    yield out(part, first, lists)

    def out(part, first, lists):
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
        nbrs = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists)))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(lists), part)), pa.array(np.arange(first, first + len(lists))), nbrs], names=["part", "src", "nbrs"])

    if not paths:
        return spark.createDataFrame([], "part long, src long, nbrs array<long>")
    return spark.range(0, len(paths), 1, len(paths)).mapInArrow(scan, "part long, src long, nbrs array<long>")


def read_variable_graph(spark: SparkSession, path: str) -> DataFrame:
    """(src, nbrs) of a graph of varying degree."""
    return read_variable_graphs(spark, [path]).select("src", "nbrs")


def read_variable_shards(spark: SparkSession, folder: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(shard, local_id, pos, nbr_local) and (shard, local_id) of the entry points of partition<i>/index/<name>."""
    paths = shard_folders(folder, f"index/{name}")
    rows = read_variable_graphs(spark, paths).select("part", "src", F.posexplode("nbrs").alias("p", "nbr_local"))
    graph = rows.select(F.col("part").alias("shard"), F.col("src").alias("local_id"), F.col("p").cast("long").alias("pos"), "nbr_local")
    starts = spark.createDataFrame([(shard, entry_point(path)) for shard, path in enumerate(paths)], "shard long, local_id long")
    return graph, starts


def write_variable_graph(edges: DataFrame, path: str, n: int, entry: int, width: int) -> None:
    """edges(src, pos, dst) of nodes 0 to n - 1 as a graph of varying degree; a node without edges has an empty list.

    Where a list stands is the sum of those before it: sums run over ranges of nodes, then within them.
    """
    spark = edges.sparkSession
    nodes = spark.range(n).select(F.col("id").alias("src"))
    lists = nodes.join(_lists(edges, ("src",), "dst"), "src", "left").withColumn("vec", F.coalesce("vec", F.array().cast("array<bigint>")))
    sized = lists.withColumns({"_bytes": 4 + 4 * F.size("vec"), "_range": F.floor(F.col("src") / 65536)})
    ranges = sized.groupBy("_range").agg(F.sum("_bytes").alias("_all"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select("_range", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_before"))
    own = W.partitionBy("_range").orderBy("src").rowsBetween(W.unboundedPreceding, -1)
    placed = sized.join(F.broadcast(ranges), "_range").withColumn("at", 24 + F.col("_before") + F.coalesce(F.sum("_bytes").over(own), F.lit(0)))
    size = 24 + (sized.agg(F.sum("_bytes")).first()[0] or 0)
    head = size.to_bytes(8, "little") + width.to_bytes(4, "little") + entry.to_bytes(4, "little") + (0).to_bytes(8, "little")
    create(path, head, size)
    target = posix(path)

    def put(batches):
        for batch in batches:
            at, vec = batch.column("at").to_pylist(), batch.column("vec").to_pylist()
            with open(target, "r+b") as f:
                for place, nbrs in zip(at, vec, strict=True):
                    f.seek(place)
                    f.write(np.array([len(nbrs), *nbrs], "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([len(at)])], names=["n"])

    placed.select("at", "vec").sortWithinPartitions("at").mapInArrow(put, "n long").agg({"n": "sum"}).collect()


def write_medoids(medoids: list[int], path: str) -> None:
    """[u32 n][u32 1] and a medoid for each shard."""
    raw = np.array([len(medoids), 1, *medoids], "<u4").tobytes()
    create(path, raw, len(raw))


def read_label_medoids(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(shard, label, local_id) of text files, one for each shard, with lines of a label and a local id."""
    out = None
    for shard, path in enumerate(paths):
        cells = F.split("value", r"\s*,\s*")
        rows = spark.read.text(path).where("trim(value) != ''").select(F.lit(shard).cast("long").alias("shard"), F.trim(cells[0]).cast("long").alias("label"), F.trim(F.element_at(cells, -1)).cast("long").alias("local_id"))
        out = rows if out is None else out.unionByName(rows)
    return out


def read_layered_graph(spark: SparkSession, path: str, n: int, top: int, layers: int, degree: int) -> DataFrame:
    """(layer, local, base_id, nbrs) of a layered file of n vectors; ValueError if its size is another."""
    g = layer_geometry(n, top, layers, degree)
    if file_size(path) != layered_file_bytes(g, degree):
        raise ValueError(f"{path}: {file_size(path)} bytes, but {layered_file_bytes(g, degree)} for {layers} layers of {n}")
    lists, names = [], []
    for layer, (rows, offset, at) in enumerate(zip(g["sizes"], g["offsets"], g["translation_offsets"], strict=True)):
        lists.append(Segment(path, 4 * offset * degree, rows, degree, "<u4", part=layer))
        if layer:
            names.append(Segment(path, 4 * (g["rows"] * degree + at), rows, 1, "<u4", part=layer))
    rows = read_segments(spark, lists, "<u4").select(F.col("part").alias("layer"), F.col("id").alias("local"), F.col("vec").alias("nbrs"))
    if not names:
        return rows.select("layer", "local", F.col("local").alias("base_id"), "nbrs")
    base = read_segments(spark, names, "<u4").select(F.col("part").alias("layer"), F.col("id").alias("local"), F.col("vec")[0].alias("base_id"))
    return rows.join(base, ["layer", "local"], "left").select("layer", "local", F.coalesce("base_id", "local").alias("base_id"), "nbrs")


def write_layered_graph(layers_: DataFrame, path: str, n: int, top: int, layers: int, degree: int) -> None:
    """(layer, local, base_id, nbrs), each with `degree` neighbours, as a layered file of n vectors."""
    g = layer_geometry(n, top, layers, degree)
    create(path, b"", layered_file_bytes(g, degree))
    files = {layer: (path, 4 * offset * degree, 4 * degree) for layer, offset in enumerate(g["offsets"])}
    rows = layers_.select(F.col("layer").cast("long").alias("part"), F.col("local").alias("pos"), F.col("nbrs").alias("vec"))
    write_rows(rows, files, "<u4")
    names = {layer: (path, 4 * (g["rows"] * degree + at), 4) for layer, at in enumerate(g["translation_offsets"]) if layer}
    above = layers_.where("layer > 0").select(F.col("layer").cast("long").alias("part"), F.col("local").alias("pos"), F.array("base_id").alias("vec"))
    if names:
        write_rows(above, names, "<u4")
