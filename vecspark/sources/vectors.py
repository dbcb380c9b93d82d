"""Vector files and what belongs to them: matrices (*bin), rows with their length (*vecs), numpy's arrays (npy), id
lists, ground truth and shard folders.

*bin: [u32 n][u32 dim][n * dim elements]; *vecs: [u32 dim][dim elements] repeated; lists of ids: [u32 n][n * u32]. A
folder of shards has partition<i>/data.<suffix> and partition<i>/idmap.ibin, and what the shards amount to.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.sources.matrices import Segment, create, file_bytes, file_size, listed, posix, read_segments, write_rows

#: numpy's type by suffix.
KINDS = {"fbin": "<f4", "u8bin": "|u1", "ibin": "<u4", "fvecs": "<f4", "bvecs": "|u1", "ivecs": "<u4"}
NUMPY = {"f4": "<f4", "f8": "<f8", "u1": "|u1", "i4": "<i4", "u4": "<u4"}


def suffix_of(path: str) -> str:
    """The suffix of a vector file; ValueError if there is no such type."""
    suffix = path.rsplit(".", 1)[-1]
    if suffix not in KINDS and suffix != "npy":
        raise ValueError(f"{path}: not one of {', '.join([*KINDS, 'npy'])}")
    return suffix


def header(path: str, suffix: str | None = None) -> Segment:
    """Where a file's rows are, how many there are and how long; ValueError if that contradicts its size."""
    suffix, size = suffix or suffix_of(path), file_size(path)
    if size < 0:
        raise FileNotFoundError(path)
    if suffix == "npy":
        return _numpy_header(path)
    kind = KINDS[suffix]
    width = np.dtype(kind).itemsize
    if suffix.endswith("bin"):
        n, dim = np.frombuffer(file_bytes(path, 0, 8), "<u4").tolist() if size >= 8 else (-1, 0)
        if size != 8 + n * dim * width:
            raise ValueError(f"{path}: {size} bytes do not hold {n} x {dim}")
        return Segment(path, 8, n, dim, kind)
    dim = int(np.frombuffer(file_bytes(path, 0, 4), "<u4")[0]) if size else 0
    stride = 4 + dim * width
    if size % stride:
        raise ValueError(f"{path}: {size} bytes are no rows of {dim}")
    return Segment(path, 0, size // stride if size else 0, dim, kind, skip=4)


def _numpy_header(path: str) -> Segment:
    from io import BytesIO

    raw = BytesIO(file_bytes(path, 0, 1 << 16))
    major, _ = np.lib.format.read_magic(raw)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if major == 1 else np.lib.format.read_array_header_2_0)(raw)
    if fortran or len(shape) != 2 or dtype.str[1:] not in NUMPY:
        raise ValueError(f"{path}: no matrix of rows of numbers")
    return Segment(path, raw.tell(), shape[0], shape[1], NUMPY[dtype.str[1:]])


def read_vectors(spark: SparkSession, path: str, suffix: str | None = None) -> DataFrame:
    """(id, vec) of a file, or of the files of a folder with a suffix, numbered on in order of their names."""
    suffix = suffix or suffix_of(path)
    segments, first = [], 0
    for name in listed(path, suffix):
        found = header(name, suffix)
        segments.append(Segment(found.path, found.offset, found.rows, found.dim, found.kind, found.skip, first))
        first += found.rows
    if len({s.dim for s in segments if s.rows}) > 1:
        raise ValueError(f"{path}: vectors differ in length")
    return read_segments(spark, segments, segments[0].kind).select("id", "vec")


def read_queries(spark: SparkSession, path: str, like: str) -> DataFrame:
    """(qid, qvec) of a query file, which must have the type of elements of another vector file."""
    if KINDS.get(suffix_of(path)) != KINDS.get(suffix_of(like)):
        raise ValueError(f"{path} has not the type of {like}")
    return read_vectors(spark, path).select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(qid, rank, id) of a matrix of true ids, nearest first; ranks are from 1."""
    rows = read_vectors(spark, path)
    return rows.select(F.col("id").alias("qid"), F.posexplode("vec").alias("at", "id")).select("qid", (F.col("at") + 1).cast("long").alias("rank"), "id")


def id_list(path: str, part: int = 0) -> Segment:
    """Where the ids of a list are; ValueError if their number contradicts the file's size."""
    size = file_size(path)
    n = int(np.frombuffer(file_bytes(path, 0, 4), "<u4")[0]) if size >= 4 else -1
    if size != 4 + 4 * n:
        raise ValueError(f"{path}: {size} bytes, but {4 + 4 * n} for {n} ids")
    return Segment(path, 4, n, 1, "<u4", part=part)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(pos, id) of a list of ids."""
    return read_segments(spark, [id_list(path)], "<u4").select(F.col("id").alias("pos"), F.col("vec")[0].alias("id"))


def shard_folders(folder: str, name: str) -> list[str]:
    """name in partition0, partition1 and so on, up to the first without it."""
    out: list[str] = []
    while file_size(path := f"{folder}/partition{len(out)}/{name}") >= 0:
        out.append(path)
    return out


def read_id_maps(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, local_id, global_id) of a folder of shards."""
    segments = [id_list(path, shard) for shard, path in enumerate(shard_folders(folder, "idmap.ibin"))]
    return read_segments(spark, segments, "<u4").select(F.col("part").alias("shard"), F.col("id").alias("local_id"), F.col("vec")[0].alias("global_id"))


def read_shards(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """(shard, local_id, global_id, vec) of a folder of shards; each has as many vectors as ids."""
    segments = []
    for shard, path in enumerate(shard_folders(folder, f"data.{suffix}")):
        found, ids = header(path, suffix), id_list(f"{folder}/partition{shard}/idmap.ibin")
        if found.rows != ids.rows:
            raise ValueError(f"partition{shard} has {found.rows} vectors and {ids.rows} ids")
        segments.append(Segment(found.path, found.offset, found.rows, found.dim, found.kind, found.skip, 0, shard))
    rows = read_segments(spark, segments, KINDS[suffix]).select(F.col("part").alias("shard"), F.col("id").alias("local_id"), "vec")
    return rows.join(read_id_maps(spark, folder), ["shard", "local_id"]).select("shard", "local_id", "global_id", "vec")


def _shape(rows: DataFrame, vec: str = "vec") -> tuple[int, int]:
    n, low, high, least, most = rows.agg(F.count("*"), F.min("pos"), F.max("pos"), F.min(F.size(vec)), F.max(F.size(vec))).first()
    if n and (low != 0 or high != n - 1 or least != most):
        raise ValueError("positions must be 0 to n - 1 and vectors of one length")
    return n, most or 0


def file_layout(n: int, dim: int, suffix: str) -> tuple[bytes, int, int, bytes]:
    """The head, the offset of rows, the stride, and what stands before each row."""
    width = np.dtype(KINDS[suffix]).itemsize
    if suffix.endswith("bin"):
        return np.array([n, dim], "<u4").tobytes(), 8, dim * width, b""
    lead = np.array([dim], "<u4").tobytes()
    return b"", 0, 4 + dim * width, lead


def write_vectors(vectors: DataFrame, path: str, suffix: str | None = None) -> None:
    """vectors(id, vec), ids from 0 without gaps, as one file; tasks write their rows at their places."""
    suffix = suffix or suffix_of(path)
    rows = vectors.select(F.lit(0).cast("long").alias("part"), F.col("id").alias("pos"), "vec")
    n, dim = _shape(rows)
    head, offset, stride, lead = file_layout(n, dim, suffix)
    create(path, head, offset + n * stride)
    write_rows(rows, {0: (path, offset, stride)}, KINDS[suffix], lead)


def converted(spark: SparkSession, source: str, target: str) -> None:
    """A vector file written as one of another type: *bin to *vecs, npy to either, and so on."""
    write_vectors(read_vectors(spark, source), target)


def head_rows(spark: SparkSession, source: str, target: str, n: int) -> None:
    """The first n vectors of a file; ValueError if it has fewer."""
    if header(source).rows < n:
        raise ValueError(f"{source} has fewer than {n} vectors")
    write_vectors(read_vectors(spark, source).where(F.col("id") < n), target)


def shuffled_rows(spark: SparkSession, source: str, target: str, seed: int = 0) -> None:
    """The vectors of a file in seeded order."""
    from pyspark.sql import Window as W

    from vecspark.operators.kmeans import seeded_share

    # ranges of a seeded number, numbered on by their sizes, so that no window holds all vectors
    rows = read_vectors(spark, source).withColumn("_key", seeded_share(seed, F.col("id"))).withColumn("_part", F.floor(F.col("_key") * 256))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(W.partitionBy("_part").orderBy("_key", "id")) - 1
    placed = rows.join(F.broadcast(sizes), "_part").withColumn("id", F.col("_before") + place)
    write_vectors(placed.select("id", "vec"), target)


def write_ids(ids: DataFrame, path: str) -> None:
    """ids(pos, id) as a list."""
    rows = ids.select(F.lit(0).cast("long").alias("part"), "pos", F.array("id").alias("vec"))
    n, _ = _shape(rows)
    create(path, np.array([n], "<u4").tobytes(), 4 + 4 * n)
    write_rows(rows, {0: (path, 4, 4)}, "<u4")


def write_shards(shards: DataFrame, vectors: DataFrame, folder: str, suffix: str, centres: DataFrame | None = None) -> dict[int, int]:
    """A folder of shards(shard, local_id, global_id) with their vectors(id, vec), sizes and centres; the sizes.

    Every shard up to the highest has files, if empty ones. Shards that a folder already has are replaced.
    """
    clean_shards(folder)
    found = {r["shard"]: r["n"] for r in shards.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    sizes = {shard: found.get(shard, 0) for shard in range(max(found, default=-1) + 1)}
    dim = (vectors.select(F.size("vec")).first() or [0])[0]
    data, ids = {}, {}
    for shard, n in sizes.items():
        head, offset, stride, lead = file_layout(n, dim, suffix)
        data[shard] = (f"{folder}/partition{shard}/data.{suffix}", offset, stride)
        ids[shard] = (f"{folder}/partition{shard}/idmap.ibin", 4, 4)
        create(data[shard][0], head, offset + n * stride)
        create(ids[shard][0], np.array([n], "<u4").tobytes(), 4 + 4 * n)
    rows = shards.select(F.col("shard").cast("long").alias("part"), F.col("local_id").alias("pos"), "global_id")
    dealt = rows.join(vectors.select(F.col("id").alias("global_id"), "vec"), "global_id").repartition("part").sortWithinPartitions("part", "pos")
    if sizes:
        write_rows(dealt, data, KINDS[suffix], lead)
        write_rows(rows.select("part", "pos", F.array("global_id").alias("vec")), ids, "<u4")
    write_report(sizes, vectors.count(), f"{folder}/partition_sizes.txt")
    if centres is not None:
        write_vectors(centres.select(F.col("shard").cast("long").alias("id"), F.col("centroid").alias("vec")), f"{folder}/centroids.bin", "fbin")
    return sizes


def write_report(sizes: dict[int, int], vectors: int, path: str) -> None:
    """A line for each shard, the total, and how often a vector is held on average."""
    total = sum(sizes.values())
    lines = [f"partition{shard} {n}" for shard, n in sizes.items()] + [f"total {total}", f"replication {total / vectors if vectors else 0:.4f}"]
    text = ("\n".join(lines) + "\n").encode()
    create(path, text, len(text))


def clean_shards(folder: str) -> None:
    """Remove partition* folders and centroids.bin of a folder, and nothing else."""
    import re
    import shutil
    from pathlib import Path

    root = Path(posix(folder))
    for path in root.iterdir() if root.is_dir() else ():
        if path.is_dir() and re.fullmatch(r"partition\d+", path.name):
            shutil.rmtree(path)
        elif path.name == "centroids.bin":
            path.unlink()
