import random

from vecspark.llm.jaccard_join import boundary, op10, one_of_each, similar_groups

from . import brute


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_fixture_matches_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert rows_of(op10(spark, sf_dir)) == brute.jaccard_groups(docs, 3, 90)


def test_random_near_copies_of_every_size(spark):
    rng, rows = random.Random(5), []
    for base in range(60):
        w = [f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 2, 3, 6, 10, 14, 20, 25, 60, 200]))]
        for _ in range(rng.randrange(1, 5)):
            v = list(w)
            for _ in range(rng.randrange(0, 3)):
                v[rng.randrange(len(v))] = rng.choice(["X", "Y", "w1"])
            rows.append((len(rows), " ".join(v)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for k, percent in ((3, 90), (2, 80), (5, 80)):
        assert rows_of(similar_groups(docs, k, percent)) == brute.jaccard_groups(rows, k, percent)


def test_nulls_empties_repeats_and_extra_columns(spark):
    long = " ".join(f"a{i}" for i in range(50_000))
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t", "x"), (5, "A b", "x"), (4, "a B", "x"), (4, "a B", "x"), (None, "a b", "x"), (7, long, "x"), (6, long + " z", "x"), (8, "É b", "x"), (9, "é b", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long" .replace("n long", "keys string"))
    got = sorted((tuple(r) for r in similar_groups(docs, 3, 90).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (5, 1, 4), (4, 1, 4), (4, 1, 4), (None, 1, 4), (7, 49998, 6), (6, 49999, 6), (8, 1, 8), (9, 1, 9)], key=str)
    assert sorted(str(r.doc_id) for r in one_of_each(docs, 3, 90).collect()) == sorted(map(str, [1, 2, 3, 4, 4, None, 6, 8, 9]))


def test_empty_table(spark):
    assert similar_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_boundary_follows_cost():
    assert boundary(90, 16) == 19 and boundary(90, 0) == 0 and boundary(80, 16) >= 9


def test_heavy_lists_in_chunks(spark, monkeypatch):
    """Many copies with edits, so that lists are long and links irregular."""
    import vecspark.llm.jaccard_join as join

    monkeypatch.setattr(join, "LIGHT_LIST", 3)
    monkeypatch.setattr(join, "CHUNK", 16)
    monkeypatch.setattr(join, "HUB_PAIRS", 5)
    rng, rows = random.Random(9), []
    for base in range(3):
        w = [f"b{base}w{i}" for i in range(80 + 20 * base)]
        for _ in range(60):
            v = list(w)
            for _ in range(rng.randrange(1, 4)):
                v[rng.randrange(len(v))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(v[: rng.randrange(len(v) - 5, len(v))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(similar_groups(docs, 3, 90)) == brute.jaccard_groups(rows, 3, 90)


def test_heavy_lists_of_many_sizes(spark, monkeypatch):
    """Beginnings of one text: all share shingles, and only those of like lengths link."""
    import vecspark.llm.jaccard_join as join

    monkeypatch.setattr(join, "LIGHT_LIST", 2)
    monkeypatch.setattr(join, "CHUNK", 3)
    rng = random.Random(2)
    w = [f"w{i}" for i in range(400)]
    lengths = [rng.choice([*range(20, 60), *range(100, 130), *range(200, 390)]) for _ in range(90)]
    rows = [(i, " ".join([*w[:n], *([f"x{i}", f"y{i}"] if i % 3 else [])])) for i, n in enumerate(lengths)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (80, 90, 100):
        assert rows_of(similar_groups(docs, 3, percent)) == brute.jaccard_groups(rows, 3, percent)
