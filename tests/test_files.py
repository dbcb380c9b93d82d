"""Files of vectors, shards and graphs, and the commands on them."""

import json

import numpy as np
import pytest

from vecspark import cli
from vecspark.functions.sizing import layer_geometry
from vecspark.operators import graph, layers, partitioning, sharding
from vecspark.sources import graphs, matrices, vectors
from vecspark.streaming import edges as streaming

#: Unsigned bytes beyond the signed ones, as plain files say them.
ROWS = np.array([[0, 127, 128, 255], [1, 2, 3, 4], [9, 8, 7, 6]])


def plain(path, suffix, rows=ROWS):
    kind = {"f": "<f4", "u": "u1", "b": "u1", "i": "<u4"}[suffix[0]]
    if suffix == "npy":
        np.save(path, rows.astype("<f4"))
    elif suffix.endswith("bin"):
        path.write_bytes(np.array(rows.shape, "<u4").tobytes() + rows.astype(kind).tobytes())
    else:
        path.write_bytes(b"".join(np.array([rows.shape[1]], "<u4").tobytes() + r.astype(kind).tobytes() for r in rows))
    return str(path)


def rows_of(df):
    return sorted((r[0], list(r[1])) for r in df.collect())


@pytest.mark.parametrize("suffix", ["fbin", "u8bin", "ibin", "fvecs", "bvecs", "ivecs"])
def test_vector_files_both_ways(spark, tmp_path, monkeypatch, suffix):
    monkeypatch.setattr(matrices, "RANGE_BYTES", 32)
    path = plain(tmp_path / f"a.{suffix}", suffix)
    found = vectors.read_vectors(spark, path)
    assert rows_of(found) == [(i, r.tolist()) for i, r in enumerate(ROWS)]
    vectors.write_vectors(found.repartition(3), str(tmp_path / f"b.{suffix}"))
    assert (tmp_path / f"b.{suffix}").read_bytes() == (tmp_path / f"a.{suffix}").read_bytes()
    plain(tmp_path / f"c.{suffix}", suffix, ROWS[::-1])
    assert rows_of(vectors.read_vectors(spark, str(tmp_path), suffix)) == [(i, r.tolist()) for i, r in enumerate([*ROWS, *ROWS, *ROWS[::-1]])]


def test_files_that_contradict_themselves(spark, tmp_path):
    for suffix in ("fbin", "fvecs", "ibin"):
        path = tmp_path / f"a.{suffix}"
        plain(path, suffix)
        path.write_bytes(path.read_bytes()[:-1])
        with pytest.raises(ValueError):
            vectors.read_vectors(spark, str(path))
    uneven = np.array([2, 1, 1, 1, 5, 5], "<u4").tobytes()
    (tmp_path / "u.ivecs").write_bytes(uneven)
    with pytest.raises(Exception, match="different length"):
        vectors.read_vectors(spark, str(tmp_path / "u.ivecs")).collect()
    with pytest.raises(ValueError, match="not one of"):
        vectors.read_vectors(spark, str(tmp_path / "a.csv"))
    with pytest.raises(FileNotFoundError):
        vectors.header(str(tmp_path / "none.fbin"))
    with pytest.raises(ValueError, match="type"):
        vectors.read_queries(spark, plain(tmp_path / "q.u8bin", "u8bin"), "base.fbin")
    (tmp_path / "e.fvecs").write_bytes(b"")
    assert vectors.read_vectors(spark, str(tmp_path / "e.fvecs")).count() == 0


def test_converters(spark, tmp_path):
    npy = str(tmp_path / "a.npy")
    np.save(npy, ROWS.astype("<f4"))
    for source, target in (("a.npy", "a.fbin"), ("a.npy", "b.fvecs"), ("a.fbin", "c.fvecs")):
        vectors.converted(spark, str(tmp_path / source), str(tmp_path / target))
    assert (tmp_path / "a.fbin").read_bytes() == open(plain(tmp_path / "w.fbin", "fbin"), "rb").read()
    assert (tmp_path / "b.fvecs").read_bytes() == (tmp_path / "c.fvecs").read_bytes() == open(plain(tmp_path / "w.fvecs", "fvecs"), "rb").read()
    vectors.head_rows(spark, str(tmp_path / "a.fbin"), str(tmp_path / "h.fbin"), 2)
    assert rows_of(vectors.read_vectors(spark, str(tmp_path / "h.fbin"))) == [(0, ROWS[0].tolist()), (1, ROWS[1].tolist())]
    with pytest.raises(ValueError):
        vectors.head_rows(spark, str(tmp_path / "a.fbin"), str(tmp_path / "x.fbin"), 4)
    many = np.arange(400).reshape(200, 2)
    vectors.shuffled_rows(spark, plain(tmp_path / "m.fbin", "fbin", many), str(tmp_path / "s.fbin"), 3)
    mixed = [v for _, v in rows_of(vectors.read_vectors(spark, str(tmp_path / "s.fbin")))]
    assert sorted(mixed) == many.tolist() and mixed != many.tolist()
    np.save(npy, np.zeros(4, "<f4"))
    with pytest.raises(ValueError, match="no matrix"):
        vectors.header(npy)


def test_id_lists_and_ground_truth(spark, tmp_path):
    (tmp_path / "ids.ibin").write_bytes(np.array([3, 7, 4294967295, 9], "<u4").tobytes())
    ids = vectors.read_ids(spark, str(tmp_path / "ids.ibin"))
    assert sorted(map(tuple, ids.collect())) == [(0, 7), (1, 4294967295), (2, 9)]
    vectors.write_ids(ids, str(tmp_path / "again.ibin"))
    assert (tmp_path / "again.ibin").read_bytes() == (tmp_path / "ids.ibin").read_bytes()
    (tmp_path / "ids.ibin").write_bytes(np.array([3, 7, 8], "<u4").tobytes())
    with pytest.raises(ValueError, match="16 for 3 ids"):
        vectors.read_ids(spark, str(tmp_path / "ids.ibin"))
    truth = vectors.read_ground_truth(spark, plain(tmp_path / "t.ibin", "ibin"))
    assert sorted(map(tuple, truth.where("qid = 2").collect())) == [(2, 1, 9), (2, 2, 8), (2, 3, 7), (2, 4, 6)]


def some_vectors(spark, n=40, seed=0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(n, 6)))], "id long, vec array<float>")


@pytest.mark.parametrize("suffix", ["fbin", "fvecs"])
def test_shard_folders(spark, tmp_path, suffix):
    base = some_vectors(spark)
    shards = sharding.direct(base, 15).where("shard != 1").union(spark.createDataFrame([(2, 10, 3)], "shard long, local_id long, global_id long"))
    (tmp_path / "partition7").mkdir()
    (tmp_path / "partitions").mkdir()
    sizes = vectors.write_shards(shards, base, str(tmp_path), suffix)
    assert sizes == {0: 15, 1: 0, 2: 11} and not (tmp_path / "partition7").exists() and (tmp_path / "partitions").exists()
    assert (tmp_path / "partition_sizes.txt").read_text().splitlines()[-2:] == ["total 26", "replication 0.6500"]
    back = vectors.read_shards(spark, str(tmp_path), suffix)
    known = {r.id: r.vec for r in base.collect()}
    assert sorted((r.shard, r.local_id, r.global_id) for r in back.collect()) == sorted(map(tuple, shards.collect()))
    assert all(r.vec == known[r.global_id] for r in back.collect())
    (tmp_path / "partition2" / "idmap.ibin").write_bytes(np.array([1, 5], "<u4").tobytes())
    with pytest.raises(ValueError, match="partition2 has 11 vectors and 1 ids"):
        vectors.read_shards(spark, str(tmp_path), suffix)


def plain_fixed(path):
    """The lists of a fixed-degree file, by numpy's own reader of frames."""
    with open(path, "rb") as f:
        tag, values = f.read(4), []
        for kind in ("<i4", "<u4", "<u4", "<u4", "<u2"):
            assert np.lib.format.read_magic(f) == (1, 0)
            _, _, dtype = np.lib.format.read_array_header_1_0(f)
            assert dtype == np.dtype(kind)
            values.append(int(np.frombuffer(f.read(dtype.itemsize), dtype)[0]))
        lists = np.lib.format.read_array(f)
        flag = np.lib.format.read_array(f)
    return tag, values, lists, flag.tolist()


def test_fixed_graphs(spark, tmp_path):
    base = some_vectors(spark)
    shards = sharding.direct(base, 20)
    local = graph.shard_knn_graph(shards, base, 4).cache()
    vectors.write_shards(shards, base, str(tmp_path), "fbin")
    graphs.write_shard_graphs(local, str(tmp_path), "g", 4)
    assert sorted(map(tuple, graphs.read_shard_graphs(spark, str(tmp_path), "g", 4).collect())) == sorted(map(tuple, local.collect()))
    merged = graph.merge(graph.remap(local, shards), 3, fixed=True).cache()
    graphs.write_fixed_graph(merged, str(tmp_path / "m"), 3)
    tag, values, lists, flag = plain_fixed(tmp_path / "m")
    assert (tag, values, flag) == (b"<f4\x00", [4, 40, 0, 3, 0], 0)
    assert {(s, p, int(d)) for s, nbrs in enumerate(lists) for p, d in enumerate(nbrs)} == {tuple(r) for r in merged.collect()}
    assert sorted(map(tuple, graphs.exploded(graphs.read_fixed_graph(spark, str(tmp_path / "m"))).collect())) == sorted(map(tuple, merged.collect()))
    with pytest.raises(ValueError, match="degree 3, not 5"):
        graphs.read_fixed_graph(spark, str(tmp_path / "m"), 5)
    with pytest.raises(ValueError, match="no gap"):
        graphs.write_fixed_graph(merged.where("src != 7"), str(tmp_path / "x"), 3)
    (tmp_path / "m").write_bytes((tmp_path / "m").read_bytes()[:-200])
    with pytest.raises(ValueError, match="too short"):
        graphs.read_fixed_graph(spark, str(tmp_path / "m"))


def test_variable_graphs(spark, tmp_path):
    edges = spark.createDataFrame([(0, 0, 3), (0, 1, 1), (3, 0, 0), (5, 0, 1), (5, 1, 2), (5, 2, 3)], "src long, pos long, dst long")
    path = tmp_path / "partition0" / "index" / "v"
    graphs.write_variable_graph(edges, str(path), 6, 5, 3)
    lists = [[3, 1], [], [], [0], [], [1, 2, 3]]
    body = b"".join(np.array([len(x), *x], "<u4").tobytes() for x in lists)
    assert path.read_bytes() == (24 + len(body)).to_bytes(8, "little") + np.array([3, 5], "<u4").tobytes() + bytes(8) + body
    assert [(r.src, r.nbrs) for r in graphs.read_variable_graph(spark, str(path)).orderBy("src").collect()] == list(enumerate(lists))
    (tmp_path / "partition1" / "index").mkdir(parents=True)
    (tmp_path / "partition1" / "index" / "v").write_bytes(path.read_bytes())
    local, starts = graphs.read_variable_shards(spark, str(tmp_path), "v")
    assert local.count() == 12 and sorted(map(tuple, starts.collect())) == [(0, 5), (1, 5)]
    graphs.write_medoids([4, 9], str(tmp_path / "medoids"))
    assert (tmp_path / "medoids").read_bytes() == np.array([2, 1, 4, 9], "<u4").tobytes()
    (tmp_path / "l0").write_text("3, 1\n4, 0\n")
    (tmp_path / "l1").write_text("3, 5\n")
    given = graphs.read_label_medoids(spark, [str(tmp_path / "l0"), str(tmp_path / "l1")])
    shards = spark.createDataFrame([(0, 0, 70), (0, 1, 71), (1, 5, 75)], "shard long, local_id long, global_id long")
    assert sorted(map(tuple, graph.medoids_of_labels(given, shards).collect())) == [(3, [71, 75]), (4, [70])]


def test_layered_files(spark, tmp_path):
    base = some_vectors(spark, 100)
    sizes = layer_geometry(100, 10, 3, 3)["sizes"]
    made = layers.layered_graph(sharding.direct(base, 100), base, sizes, 3).cache()
    path = str(tmp_path / "part_0.graph")
    graphs.write_layered_graph(made, path, 100, 10, 3, 3)
    raw = np.frombuffer(open(path, "rb").read(), "<u4")
    by = {(r.layer, r.local): r for r in made.collect()}
    assert raw[: 3 * 100].reshape(100, 3).tolist() == [by[0, i].nbrs for i in range(100)]
    assert raw[3 * sum(sizes) : 3 * sum(sizes) + sizes[1]].tolist() == [by[1, i].base_id for i in range(sizes[1])]
    back = graphs.read_layered_graph(spark, path, 100, 10, 3, 3)
    assert {tuple(map(str, r)) for r in back.collect()} == {tuple(map(str, r)) for r in made.select(back.columns).collect()}
    with pytest.raises(ValueError, match="bytes, but"):
        graphs.read_layered_graph(spark, path, 101, 10, 3, 3)


def test_partition_wrappers(spark):
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(6, 4)) * 20
    base = spark.createDataFrame([(i, (middles[i % 6] + rng.normal(size=4)).tolist()) for i in range(300)], "id long, vec array<float>")
    gib = 120 * 4 * (4 + 64) / (1 << 30)
    made = partitioning.partition(base, 16, 2, gib, 1.5, rate=1.0, seed=3)
    assert made.plan["parts"] > 2 and made.centres.count() == made.plan["parts"]
    assert made.assigned.where("home").select("id").distinct().count() == 300
    assert made.shards.groupBy("shard").count().agg({"count": "max"}).first()[0] <= made.plan["limit"]
    assert partitioning.partition(base, 16, 2, 1, 1.5).shards.select("shard").distinct().count() == 1
    plain = partitioning.fitting_partition(base, 16, 2, 160 * (16 + 256 + 40) / (1 << 30))
    assert plain.plan["parts"] > 3 and plain.shards.count() == 600
    with pytest.raises(ValueError, match="fits"):
        partitioning.fitting_partition(base.where("id < 5"), 16, 2, 1e-9)


@pytest.fixture(scope="module")
def smoke(tmp_path_factory):
    """A thousand random byte vectors, the first ten as queries, and their true neighbours."""
    root = tmp_path_factory.mktemp("smoke")
    rng = np.random.default_rng(8)
    base = rng.integers(0, 255, (1000, 32))
    truth = np.array([np.lexsort((np.arange(1000), ((base - q) ** 2).sum(axis=1)))[:10] for q in base[:10]])
    plain(root / "base.u8bin", "u8bin", base)
    plain(root / "query.u8bin", "u8bin", base[:10])
    plain(root / "truth.ibin", "ibin", truth)
    return root


def run(spark, capsys, *argv):
    out = cli.main([str(x) for x in argv], spark)
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == out
    return out


def test_commands_from_partition_to_search(spark, smoke, capsys):
    folder = smoke / "shards"
    gib = 500 * (32 + 4 * 16 * 4 + 40) / (1 << 30)
    made = run(spark, capsys, "partition", "--data-path", smoke / "base.u8bin", "--base-folder", folder, "--memory", gib, "--degree", 16, "--replicas", 2, "--epsilon", 1.2, "--sampling-rate", 1, "--max-iteration", 3)
    assert made["parts"] == len(made["sizes"]) > 3 and sum(made["sizes"]) > 1000 and max(made["sizes"]) <= made["limit"]
    assert vectors.read_vectors(spark, str(folder / "centroids.bin"), "fbin").count() == made["parts"]
    run(spark, capsys, "build", "--base-folder", folder, "--suffix", "u8bin", "--index-name", "g", "--degree", 16, "--intermediate", 32)
    assert "edges" in (folder / "build_time.txt").read_text()
    out = run(spark, capsys, "merge", "--base-folder", folder, "--index-name", "g", "--degree", 16)
    asked = ["--data", smoke / "base.u8bin", "--query", smoke / "query.u8bin", "--truth", smoke / "truth.ibin", "--k", 10]
    found = run(spark, capsys, "search", *asked, "--index", out["index"], "--pool", 64)
    assert found["recall"] >= 85 and found["queries"] == 10 and found["computed"] == 640 + found["visited"]
    assert run(spark, capsys, "search", *asked, "--index", out["index"], "--pool", 1000)["recall"] == 100
    parts = run(spark, capsys, "search-shards", *asked, "--index-dir", folder, "--index-name", "g", "--pool", 64)
    assert parts["recall"] >= 90
    ragged = run(spark, capsys, "variable-merge", "--base-folder", folder, "--suffix", "u8bin", "--index-name", "g", "--degree", 24)
    assert len(ragged["medoids"]) == made["parts"]
    assert run(spark, capsys, "search", *asked, "--index", ragged["index"], "--variable", "--pool", 1000)["recall"] == 100


def test_pipelined_merge_takes_each_shard_once(spark, smoke, capsys):
    folder = smoke / "blocks"
    sizes = run(spark, capsys, "direct-partition", "--data-path", smoke / "base.u8bin", "--base-folder", folder, "--shard-size", 400)["sizes"]
    assert sizes == [400, 400, 200]
    run(spark, capsys, "build", "--base-folder", folder, "--suffix", "u8bin", "--index-name", "g", "--degree", 8, "--random")
    merge = ["pipelined-merge", "--base-folder", folder, "--index-name", "g", "--degree", 4, "--nshards", 3]
    (folder / "partition1" / "build.done").touch()
    assert run(spark, capsys, *merge) == {"shards": 1, "of": 3}
    for shard in (0, 2):
        (folder / f"partition{shard}" / "build.done").touch()
    out = run(spark, capsys, *merge)
    assert out["shards"] == 3 and out["edges"] == 4000
    edges = spark.read.parquet(str(folder / "pipelined" / "edges"))
    assert edges.count() == 8000 and edges.select("epoch").distinct().count() == 2
    whole = graph.remap(graphs.read_shard_graphs(spark, str(folder), "g"), vectors.read_id_maps(spark, str(folder)))
    assert sorted(map(tuple, edges.select("src", "dst").collect())) == sorted(map(tuple, whole.collect()))
    streaming.ingest(spark, f"{folder}/pipelined/arrived/*", vectors.read_id_maps(spark, str(folder)), f"{folder}/pipelined/edges", f"{folder}/pipelined/checkpoint")
    assert spark.read.parquet(str(folder / "pipelined" / "edges")).count() == 8000


def test_layered_and_other_commands(spark, smoke, capsys):
    base = vectors.read_vectors(spark, str(smoke / "base.u8bin"))
    sizes = layer_geometry(500, 16, 3, 8)["sizes"]
    made = layers.layered_graph(sharding.direct(base, 500), base, sizes, 8).cache()
    for shard in (0, 1):
        own = made.where(made["shard"] == shard).withColumn("base_id", made["base_id"] - 500 * shard)
        graphs.write_layered_graph(own, str(smoke / f"part_{shard}.graph"), 500, 16, 3, 8)
    asked = ["--data", smoke / "base.u8bin", "--query", smoke / "query.u8bin", "--truth", smoke / "truth.ibin", "--k", 10]
    found = run(spark, capsys, "search-layered", *asked, "--index-dir", smoke, "--shard-size", 500, "--degree", 8, "--layers", 3, "--segment-size", 16, "--pool", 100)
    assert found["recall"] >= 85
    run(spark, capsys, "convert", "--source", smoke / "base.u8bin", "--target", smoke / "few.bvecs", "--rows", 5)
    assert vectors.header(str(smoke / "few.bvecs")).rows == 5
    out = run(spark, capsys, "fitting-partition", "--data-path", smoke / "base.u8bin", "--base-folder", smoke / "fit", "--memory", 900 * (32 + 256 + 40) / (1 << 30), "--degree", 16, "--replicas", 2)
    assert sum(out["sizes"]) == 2000
    with pytest.raises(ValueError, match="vectors are"):
        cli.element_bytes("x.ibin")
    with pytest.raises(SystemExit):
        cli.main(["search", "--k", "3"], spark)
