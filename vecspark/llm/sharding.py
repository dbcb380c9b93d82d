"""Size-tiered compaction of text shards under a versioned manifest.

Arrivals are appended as small immutable shards. Compaction puts the shards that a manifest names into tiers of
similar size (each `FANOUT` times the one before), packs the runs of a tier in order of arrival into files of about
the target size, and commits the next version.

Commit. Every writer writes shards and the new manifest, a Parquet table with a row for each shard, into folders of its
own. A version is one small file that names its manifest: it is written aside as a whole and then linked (on a local or
mounted file system) or renamed (elsewhere) to its final name, which fails if that is there. So readers see the version
before or all of the new one, of two writers of one version one fails, and what a lost writer leaves is in no version:
the write can be tried again at once, and vacuum() deletes the remains.

Manifests stay tables: they are read, planned and written as DataFrames. The driver gets the paths that a scan reads,
as Spark itself does, and a compaction takes at most `BATCH_SHARDS` of them for a job.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecspark.llm.shared import WRITING, load, settings, work_dir

#: Documents of an arrival, bytes of text that a merged shard aims at, and what parts tiers.
ARRIVAL_ROWS, TARGET_BYTES, FANOUT, SMALLEST_TIER = 1000, 32 << 20, 4, 64 << 10
#: Shards in a cell of the running sums, shards that one job merges, and commits that an append tries.
CELL, BATCH_SHARDS, TRIES = 1024, 20_000, 10
MANIFEST = "shard_id string, first long, shard_rows long, shard_bytes long, folder string"


class ShardStore:
    """A folder of shards and manifests; the folder must be shared by all executors."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.schema = spark, root, None
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(folder))] if self.fs.exists(self._path(folder)) else []

    def _write(self, df: DataFrame, name: str, parts: str | None = None) -> None:
        """df as Parquet below the root; its shuffle files go when it ends."""
        with settings(self.spark, WRITING):
            writer = df.write.option("compression", "zstd")
            (writer.partitionBy(parts) if parts else writer).parquet(f"{self.root}/{name}")

    def versions(self) -> list[int]:
        return sorted(int(n[1:]) for n in self._names("versions") if n.startswith("v"))

    def _named(self, version: int) -> dict:
        """What a version's file says."""
        stream = self.fs.open(self._path(f"versions/v{version}"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, manifest: DataFrame, version: int, arrivals: DataFrame | None = None) -> None:
        """Write a manifest and make it the version; FileExistsError if another writer has committed the version."""
        own = uuid.uuid4().hex
        self._write(manifest, f"manifests/{own}")
        appended = list(self._named(version - 1)["arrivals"]) if version - 1 in self.versions() else []
        if arrivals is not None:
            self._write(arrivals, f"arrivals/{own}")
            appended.append(f"arrivals/{own}")
        self.fs.mkdirs(self._path("versions"))
        aside, final = self._path(f"aside/{own}"), self._path(f"versions/v{version}")
        out = self.fs.create(aside, False)
        out.write(bytearray(json.dumps({"manifest": f"manifests/{own}", "arrivals": appended}).encode()))
        out.close()
        if not self._placed(aside, final):
            raise FileExistsError(f"version {version} is there already")

    def _placed(self, aside, final) -> bool:
        """Give a written file its final name if no other file has it."""
        if self.fs.getScheme() != "file":
            return self.fs.rename(aside, final)
        files, local = self.jvm.java.nio.file.Files, lambda p: self.jvm.java.io.File(p.toUri().getPath()).toPath()
        try:
            files.createLink(local(final), local(aside))
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        finally:
            self.fs.delete(aside, False)
        return True

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.versions()[-1] if version is None else version
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/{self._named(version)['manifest']}")

    def append(self, docs: DataFrame, arrival: str = "arrival") -> None:
        """Append docs(text, arrival, ...) as one shard for each arrival and commit the next version.

        Shards don't change, so an arrival that a version holds is refused. One whose writer was lost before its commit
        is in no version, and can be appended again. Where another writer commits first, the commit is tried again
        on top of it.
        """
        folder = f"in_write=w{uuid.uuid4().hex}"
        named = docs.withColumn("shard_id", F.concat(F.lit("r0-"), F.col(arrival).cast("string")))
        self.schema = docs.schema
        self._refuse_known(named.select("shard_id"))
        self._write(named.repartition("shard_id"), f"data/{folder}", "shard_id")
        shards = named.groupBy("shard_id").agg(
            F.min(arrival).cast("long").alias("first"), F.count("*").alias("shard_rows"), F.sum(text_bytes()).cast("long").alias("shard_bytes")
        )
        self._write(shards.withColumn("folder", F.lit(folder)), f"appended/{folder}")
        new = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/appended/{folder}")
        for _ in range(TRIES):
            versions = self.versions()
            try:
                self.commit(self.manifest(versions[-1]).unionByName(new) if versions else new, versions[-1] + 1 if versions else 1, new.select("shard_id"))
                return
            except FileExistsError:
                self._refuse_known(new.select("shard_id"))
        raise FileExistsError(f"other writers were first {TRIES} times")

    def _refuse_known(self, ids: DataFrame) -> None:
        versions = self.versions()
        if not versions or not (before := self._named(versions[-1])["arrivals"]):
            return
        known = self.spark.read.schema("shard_id string").parquet(*[f"{self.root}/{p}" for p in before])
        if there := ids.join(known, "shard_id", "left_semi").distinct().take(5):
            raise FileExistsError(f"there already: {sorted(r.shard_id for r in there)}")

    def compact(self, target: int = TARGET_BYTES, fanout: int = FANOUT) -> int:
        """Merge similarly sized runs once; returns how many files were made. Commits a version if any.

        A job reads the shards of some bins and writes each bin as one file; their rows move once.
        """
        version = self.versions()[-1] + 1
        plan_at = f"plans/{uuid.uuid4().hex}"
        made = F.concat(F.lit(f"r{version - 1}-"), F.min("first").over(W.partitionBy("tier", "bin")).cast("string"))
        self._write(planned(self.manifest(version - 1), target, fanout).withColumn("into", F.when(F.col("bin").isNotNull(), made)), plan_at)
        plan = self.spark.read.parquet(f"{self.root}/{plan_at}")
        merging = plan.where("into is not null")
        n_shards, n_files = merging.agg(F.count("*"), F.count_distinct("into")).first()
        if not n_shards:
            self.fs.delete(self._path(plan_at), True)
            return 0
        folder = f"in_write=w{uuid.uuid4().hex}"
        batches = -(-n_shards // BATCH_SHARDS)
        for batch in range(batches):
            some = merging.where(F.pmod(F.xxhash64("into"), F.lit(batches)) == batch).select("shard_id", "folder", "into")
            paths = [f"{r.folder}/shard_id={r.shard_id}" for r in some.collect()]
            if not paths:
                continue
            source = self._rows(paths)
            # a batch has a bounded number of shards, and so has the broadcast plan
            merged = source.join(F.broadcast(some.select("shard_id", "into")), "shard_id").drop("shard_id").withColumnRenamed("into", "shard_id")
            self._write(merged.repartition("shard_id"), f"data/{folder}{batch}", "shard_id")
        into = merging.groupBy(F.col("into").alias("shard_id")).agg(
            F.min("first").alias("first"), F.sum("shard_rows").alias("shard_rows"), F.sum("shard_bytes").alias("shard_bytes")
        )
        into = into.withColumn("folder", F.concat(F.lit(folder), F.pmod(F.xxhash64("shard_id"), F.lit(batches)).cast("string")))
        kept = plan.where("into is null").select("shard_id", "first", "shard_rows", "shard_bytes", "folder")
        self.commit(kept.unionByName(into), version)
        self.fs.delete(self._path(plan_at), True)
        return n_files

    def _rows(self, paths: list[str]) -> DataFrame:
        found = self.spark.read.option("basePath", f"{self.root}/data").parquet(*[f"{self.root}/data/{p}" for p in paths])
        return found.withColumn("shard_id", F.col("shard_id").cast("string")).drop("in_write")

    def read(self, version: int | None = None) -> DataFrame:
        """The documents of a version with shard_id."""
        paths = [f"{r.folder}/shard_id={r.shard_id}" for r in self.manifest(version).select("folder", "shard_id").toLocalIterator()]
        return self._rows(paths) if paths else self.spark.createDataFrame([], self.schema).withColumn("shard_id", F.lit(""))

    def vacuum(self, keep: int = 1, older_than: float = 3600) -> int:
        """Delete all versions but the last `keep`, and shards and tables of more than so many seconds that none of
        these names; returns how many folders went. Seconds spare writers at work, which have not committed yet."""
        versions = self.versions()
        kept = versions[-keep:]
        for version in versions[: len(versions) - len(kept)]:
            self.fs.delete(self._path(f"versions/v{version}"), False)
        used, folders = {"arrivals"}, set()
        for version in kept:
            named = self._named(version)
            used |= {named["manifest"], *named["arrivals"]}
            folders |= {r.folder for r in self.manifest(version).select("folder").distinct().collect()}
        used |= {f"data/{f}" for f in folders}
        gone = 0
        for top in ("data", "manifests", "arrivals", "appended", "plans", "aside"):
            for name in self._names(top):
                path = self._path(f"{top}/{name}")
                if f"{top}/{name}" not in used and time.time() - self.fs.getFileStatus(path).getModificationTime() / 1000 >= older_than:
                    gone += bool(self.fs.delete(path, True))
        return gone


def text_bytes():
    return F.octet_length(F.coalesce(F.col("text"), F.lit("")))


def planned(manifest: DataFrame, target: int, fanout: int) -> DataFrame:
    """manifest with tier and bin (null: not merged now). Shards over half the target stay. Others of one tier fill
    bins in order of arrival; a bin of one stays. Sums run over cells of arrivals and then within them."""
    steps, edge = [], SMALLEST_TIER
    while edge < target:
        steps.append(F.when(F.col("shard_bytes") >= edge, 1).otherwise(0))
        edge *= fanout
    cut = manifest.withColumns({"tier": sum(steps, F.lit(0)), "_small": 2 * F.col("shard_bytes") <= target, "_cell": F.floor(F.col("first") / CELL)})
    cells = cut.where("_small").groupBy("tier", "_cell").agg(F.sum("shard_bytes").alias("_bytes"))
    earlier = W.partitionBy("tier").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select("tier", "_cell", F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_earlier"))
    order = W.partitionBy("tier", "_cell", "_small").orderBy("first", "shard_id").rowsBetween(W.unboundedPreceding, -1)
    before = F.col("_earlier") + F.coalesce(F.sum("shard_bytes").over(order), F.lit(0))
    return (
        cut.join(cells, ["tier", "_cell"], "left")
        .withColumn("bin", F.when(F.col("_small"), F.floor(before / target)))
        .withColumn("_n", F.count("*").over(W.partitionBy("_small", "tier", "bin")))
        .withColumn("bin", F.when(F.col("_n") > 1, F.col("bin")))
        .drop("_small", "_n", "_cell", "_earlier")
    )


def shard_documents(docs: DataFrame, root: str, arrival_rows: int = ARRIVAL_ROWS, target: int = TARGET_BYTES, fanout: int = FANOUT) -> ShardStore:
    """Append docs in arrivals of about arrival_rows rows and compact them until nothing is left to merge.

    A row's arrival comes from a digest of its doc_id and text, by the number of rows, so neither sparse, repeated nor
    null ids make arrivals of one row or of all. A null text has 0 bytes; a very long one is a row as any other; rows
    that repeat are kept, in one arrival; an empty table makes an empty manifest. Columns of docs are stored as they
    are; arrival and shard_id are added, and replace columns of these names.
    """
    store = ShardStore(docs.sparkSession, root)
    arrivals = max(1, -(-docs.count() // arrival_rows))
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("text"))), 1, 8), 16, 10).cast("long")
    store.append(docs.withColumn("arrival", digest % arrivals))
    while store.compact(target, fanout):
        pass
    return store


def op3(spark, sf_dir: str) -> DataFrame:
    """Where the last version has every document, and how large its shard is."""
    store = shard_documents(load(spark, sf_dir, "documents"), work_dir(spark, "shards"))
    rows = store.read().select("doc_id", "arrival", "shard_id", text_bytes().cast("long").alias("n_bytes"))
    return rows.join(store.manifest().select("shard_id", "shard_rows", "shard_bytes"), "shard_id")


def _round_sql(n: int) -> str:
    edges, edge = [], SMALLEST_TIER
    while edge < TARGET_BYTES:
        edges.append(f"(shard_bytes >= {edge})::INT")
        edge *= FANOUT
    return f"""p{n} AS (
  SELECT *, 2 * shard_bytes <= {TARGET_BYTES} AS small, {" + ".join(edges)} AS tier FROM m{n - 1}
), q{n} AS (
  SELECT *, CASE WHEN small THEN coalesce(sum(shard_bytes) OVER (PARTITION BY small, tier ORDER BY first, shard_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {TARGET_BYTES} END AS bin FROM p{n}
), r{n} AS (SELECT *, small AND count(*) OVER (PARTITION BY small, tier, bin) > 1 AS merges FROM q{n}
), o{n} AS (SELECT *, CASE WHEN merges THEN min(first) OVER (PARTITION BY merges, tier, bin) ELSE first END AS into_first FROM r{n}
), a{n} AS (
  SELECT d.doc_id, d.arrival, d.n_bytes, o.into_first AS first, CASE WHEN merges THEN 'r{n}-' || into_first ELSE d.shard_id END AS shard_id
  FROM a{n - 1} d JOIN o{n} o USING (shard_id)
), m{n} AS (SELECT shard_id, min(first) AS first, count(*) AS shard_rows, sum(n_bytes)::BIGINT AS shard_bytes FROM a{n} GROUP BY shard_id
)"""


#: Rounds that the SQL unrolls; tables of the size that it is run on settle in fewer, and a round more changes nothing.
SQL_ROUNDS = 4
OP3_SQL = f"""
WITH n AS (SELECT greatest(1, ceil(count(*) / {ARRIVAL_ROWS}))::BIGINT AS n FROM documents
), a0 AS (
  SELECT doc_id, arrival, n_bytes, arrival AS first, 'r0-' || arrival AS shard_id FROM (
    SELECT doc_id, ('0x' || substr(md5(concat_ws(':', doc_id::VARCHAR, text)), 1, 8))::BIGINT % n AS arrival, strlen(coalesce(text, ''))::BIGINT AS n_bytes FROM documents, n)
), m0 AS (SELECT shard_id, min(first) AS first, count(*) AS shard_rows, sum(n_bytes)::BIGINT AS shard_bytes FROM a0 GROUP BY shard_id
), {", ".join(_round_sql(n) for n in range(1, SQL_ROUNDS + 1))}
SELECT doc_id, arrival, shard_id, n_bytes, shard_rows, shard_bytes FROM a{SQL_ROUNDS} JOIN m{SQL_ROUNDS} USING (shard_id)
"""
