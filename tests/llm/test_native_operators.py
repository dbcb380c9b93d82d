"""Quality rules, mixing, sharding, fingerprints and url filter."""

import hashlib
from collections import Counter

import duckdb
import pytest

from vecspark.llm import mixing, order_minhash, quality_rules, registry, sharding, url_filter
from vecspark.llm.shared import work_dir

from . import brute


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql_twin(spark, sf_dir, name):
    got = registry.QUERIES[name](spark, sf_dir)
    con = duckdb.connect()
    for table in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    columns = sorted(got.columns)
    wanted = con.sql(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES[name]})").fetchall()
    assert Counter(map(str, (tuple(r) for r in got.select(columns).collect()))) == Counter(map(str, wanted))


ODD = [(1, None, None, 5), (2, "", "a", 5), (3, " \n\t", "a", 5), (4, "x", None, 5), (5, "One two three. " * 9000, "b", 5), (5, "One two three. " * 9000, "b", 5), (None, "a b c", "a", 5)]
SCHEMA = "doc_id long, text string, source string, size int"


def test_rules_on_odd_rows(spark):
    found = quality_rules.judged(spark.createDataFrame(ODD, SCHEMA)).collect()
    assert len(found) == 7 and {r.kept for r in found} == {False}
    assert {r.n_repeat_words for r in found if r.doc_id == 5} == {27000}
    assert quality_rules.apply_rules(spark.createDataFrame([], SCHEMA)).columns == ["doc_id", "text", "source", "size"]


#: Windows "a105453 b c" and "a221927 b c" have the same lower 34 bits of their hashes.
COLLIDING = "a105453 b c u1 u2 u3 a221927 b c v1 v2 v3 a105453 b c"


def test_repeated_windows(spark):
    texts = ["a b c a b c", "a a a a", "a b c d e", "x a b c y a b c z", "a b a b a", COLLIDING, f"{COLLIDING} a221927 b c", "a105453 b c a221927 b c", f"{COLLIDING} a b a b a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in quality_rules.measured(docs).collect():
        assert row.n_repeat_words == brute.repeat_words(texts[row.doc_id])


def test_rules_against_a_plain_version(spark, sf_dir):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    extra = {-1: COLLIDING * 4, -2: "Home | About | Login\n" + "This is a sentence of some words. " * 20, -3: "\n".join(f"A line that ends well {i} times over." for i in range(30)) + "\nRead more\nHome\n" + "x " * 5}
    docs = spark.createDataFrame(list((rows | extra).items()), "doc_id long, text string")
    for r in quality_rules.judged(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.cleaned) == brute.rules((rows | extra)[r.doc_id])


def test_rejected_documents_and_failed_lines_go(spark):
    sentences = "\n".join(f"Line number {i} says w{i} x{i} y{i} and then stops." for i in range(20))
    text = f"Home | About | Login\n  {sentences}\nClick here to go on.\n"
    schema = "doc_id long, text string, n_words string, kept string, _words int, n_chars int, `a.b` int"
    docs = spark.createDataFrame([(1, text, "mine", "own", 7, 3, 4), (1, text, "mine", "own", 7, 3, 4), (None, text, None, None, None, None, None), (3, None, "x", "y", 1, 1, 1)], schema)
    out = quality_rules.apply_rules(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, sentences, "mine", "own", 7, len(sentences), 4)] * 2 + [(None, sentences, None, None, None, len(sentences), None)], key=str)


def test_a_filter_on_verdicts_stays_above_the_measures(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = quality_rules.judged(docs)
    assert found.where("kept and n_repeat_words >= 0 and not base_failed").count() == sum(r.kept for r in found.select("kept").collect())
    from contextlib import redirect_stdout
    from io import StringIO

    with redirect_stdout(plan := StringIO()):
        found.where("kept").select("doc_id").explain()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan.getvalue()


def test_mix_on_odd_rows(spark):
    rows = mixing.mix(spark.createDataFrame(ODD, SCHEMA)).collect()
    assert len(rows) == 7 and all(0 <= r.taken <= 2 * r.size for r in rows)
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert {r.taken for r in mixing.mix(spark.createDataFrame(ODD[:3], SCHEMA)).collect()} == {0}


@pytest.mark.parametrize("cell", [1024, 2])
def test_mix_near_targets_and_documents(spark, sf_dir, monkeypatch, cell):
    monkeypatch.setattr(mixing, "CELL", cell)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.mix(docs, shard_words=2000).collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(t - k) <= 16 * 30 for t, k in by.values())
    taken = Counter()
    for r in mixing.mixed_documents(docs, shard_words=2000).select("doc_id", "text").collect():
        taken[r.doc_id] += len(brute.words(r.text))
    assert taken == Counter({r.doc_id: r.taken for r in rows if r.taken})


def test_mixed_rows_keep_their_own_quota(spark):
    """Repeated and null ids, clashing columns; each row against the mix of rows with ids of their own."""
    texts = [" ".join(f"w{i}x{j}" for j in range(5 + 13 * i % 90)) for i in range(40)]
    rows = [(i // 3 if i % 4 else None, t, f"s{i % 3}" if i % 5 else None, 7, "x", i) for i, t in enumerate(texts)]
    rows += [rows[3], rows[4], (None, None, "s1", 1, "y", -1), (9, "", "s2", 2, "z", -2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, taken string, n_chars int")
    out = mixing.mixed_documents(docs, block=4, shard_words=200)
    assert out.dtypes == docs.dtypes
    got = Counter()
    whole = {t: (d, s) for d, t, s, *_ in rows}
    for r in out.collect():
        origin = next(t for t in texts if t == r.text or t.startswith(r.text + " "))
        assert whole[origin] == (r.doc_id, r.source) and r.n_chars == len(r.text) and (r.size, r.taken) == (7, "x")
        got[(r.doc_id, r.source)] += len(r.text.split())
    wanted = Counter()
    for r in mixing.mix(docs, block=4, shard_words=200).collect():
        wanted[(r.doc_id, r.source)] += r.taken
    assert got == +wanted and sum(got.values()) > sum(map(len, map(str.split, texts)))
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.mixed_documents(docs.repartition(7), block=4, shard_words=200).collect()))


def plain_mix(rows, block, share=1.5, most=2.0, weights=(5, 2, 1)):
    """Targets by raising a water level source by source, and blocks one at a time by the highest quotient."""
    size = Counter()
    for _, text, source in rows:
        size[source] += len(brute.words(text))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = {}, share * sum(size.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if most * size[s] < weight[s] * level}
        for s in full or open_:
            target[s] = most * size[s] if full else weight[s] * level
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    blocks = Counter()
    for _ in range(int(sum(target.values()) / block + 1e-9)):
        blocks[max(names, key=lambda s: (target[s] / (2 * blocks[s] + 1), -names.index(s)))] += 1
    return target, blocks


def test_mix_against_a_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    rows = [tuple(r) for r in docs.collect()]
    target, blocks = plain_mix(rows, 16)
    found: dict = {}
    for r in mixing.mix(docs).collect():
        found.setdefault(r.source, []).append(r)
    for source, some in found.items():
        assert all(abs(r.target - target[source]) < 1e-6 * target[source] for r in some)
        # one shard for each source here: its quota, but no more than twice its words
        assert sum(r.taken for r in some) == min(16 * blocks[source], 2 * sum(r.size for r in some))


def test_seats_are_those_of_highest_quotients(spark):
    claims = [(g, k, float(v), w) for g, votes, w in ((0, [53, 24, 23], 10), (1, [1000, 1, 1, 0], 7), (2, [5, 5], 3)) for k, v in enumerate(votes)]
    df = spark.createDataFrame(claims, "g int, k int, votes double, wanted long")
    got = {(r.g, r.k): r.seats for r in mixing.apportioned(df, ["g"], "k", "seats").collect()}
    for g in range(3):
        own = [(k, v) for h, k, v, _ in claims if h == g]
        wanted = next(w for h, _, _, w in claims if h == g)
        ranked = sorted(((-v / (2 * j + 1), k) for k, v in own for j in range(wanted) if v), key=lambda x: x)[:wanted]
        assert {k: got[g, k] for k, _ in own} == {k: sum(1 for _, x in ranked if x == k) for k, _ in own}


def plain_compaction(shards, target, fanout):
    """{arrival: bytes} to the set of frozensets of arrivals that are files in the end."""
    files = [((a,), n) for a, n in shards.items()]
    while True:
        tiers: dict = {}
        for f, n in sorted(files):
            if 2 * n <= target:
                tier, edge = 0, sharding.SMALLEST_TIER
                while edge < target:
                    tier, edge = tier + (n >= edge), edge * fanout
                tiers.setdefault(tier, []).append((f, n))
        bins: dict = {}
        for tier, some in tiers.items():
            total = 0
            for f, n in some:
                bins.setdefault((tier, total // target), []).append((f, n))
                total += n
        merged = [some for some in bins.values() if len(some) > 1]
        if not merged:
            return {frozenset(f) for f, _ in files}
        gone = {f for some in merged for f, _ in some}
        files = [x for x in files if x[0] not in gone] + [(tuple(sorted(a for f, _ in some for a in f)), sum(n for _, n in some)) for some in merged]


def test_shards_keep_rows_and_versions(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(sharding, "CELL", 3)
    monkeypatch.setattr(sharding, "BATCH_SHARDS", 7)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = sharding.shard_documents(docs, work_dir(spark, "shards"), arrival_rows=10, target=150_000)
    assert sorted(store.read().select(docs.columns).collect()) == sorted(docs.collect())
    assert sorted(store.read(1).select(docs.columns).collect()) == sorted(docs.collect()) and len(store.versions()) > 1
    rows = store.read().select("arrival", "shard_id", "text").collect()
    size: Counter = Counter()
    files: dict = {}
    for r in rows:
        size[r.arrival] += len(r.text.encode())
        files.setdefault(r.shard_id, set()).add(r.arrival)
    assert set(map(frozenset, files.values())) == plain_compaction(size, 150_000, sharding.FANOUT) and len(files) < len(size)
    assert store.compact(150_000) == 0
    before = store.versions()
    assert store.vacuum(keep=1, older_than=0) > 0 and store.versions() == before[-1:]
    assert sorted(store.read().select(docs.columns).collect()) == sorted(docs.collect())
    odd = sharding.shard_documents(spark.createDataFrame(ODD, SCHEMA).selectExpr("*", "1 AS arrival", "2 AS shard_id", "3 AS in_write"), work_dir(spark, "shards"))
    assert odd.read().count() == 7


def test_sparse_repeated_and_null_ids_make_arrivals_by_count(spark):
    for column in ("id * 1000003", "null", "7"):
        docs = spark.range(400).selectExpr(f"cast({column} AS long) AS doc_id", "concat('t', id) AS text")
        store = sharding.ShardStore(spark, work_dir(spark, "shards"))
        made = sharding.shard_documents(docs, store.root, arrival_rows=40)
        assert 6 <= made.manifest(1).count() <= 10 and made.read().count() == 400


def test_of_two_writers_of_a_version_one_fails(spark):
    from concurrent.futures import ThreadPoolExecutor

    store = sharding.ShardStore(spark, work_dir(spark, "shards"))
    store.append(spark.createDataFrame([(1, "a", 0)], "doc_id long, text string, arrival int"))
    manifest = store.manifest()

    def writer(i):
        try:
            sharding.ShardStore(spark, store.root).commit(manifest.limit(i % 2), 2)
            return i
        except FileExistsError:
            return None

    with ThreadPoolExecutor(6) as pool:
        won = [x for x in pool.map(writer, range(6)) if x is not None]
    assert len(won) == 1 and store.manifest(2).count() == won[0] % 2 and store.versions() == [1, 2]


def test_appends_at_once_all_arrive_and_none_twice(spark):
    from concurrent.futures import ThreadPoolExecutor

    store = sharding.ShardStore(spark, work_dir(spark, "shards"))
    part = lambda i: spark.createDataFrame([(i, f"t{i}", i)], "doc_id long, text string, arrival int")
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda i: sharding.ShardStore(spark, store.root).append(part(i)), range(3)))
    assert sorted(r.doc_id for r in store.read().collect()) == [0, 1, 2] and store.versions() == [1, 2, 3]
    store.compact(1000)
    with pytest.raises(FileExistsError):  # also when its shard has been merged
        store.append(part(1))
    assert store.read().count() == 3


def test_a_writer_lost_before_its_commit_can_try_again(spark, monkeypatch):
    store = sharding.ShardStore(spark, work_dir(spark, "shards"))
    docs = spark.createDataFrame([(1, "a", 0), (2, "b", 1)], "doc_id long, text string, arrival int")
    with monkeypatch.context() as m:
        m.setattr(sharding.ShardStore, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.append(docs)
    assert store.versions() == []
    store.append(docs)
    with monkeypatch.context() as m:
        m.setattr(sharding.ShardStore, "_placed", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.compact(1000)
    assert store.versions() == [1] and store.compact(1000) == 1
    assert store.read().count() == 2 and store.vacuum(older_than=10_000) == 0 and store.vacuum(older_than=0) > 3
    assert store.read().count() == 2 and store.manifest().count() == 1


def test_shards_of_an_empty_table(spark):
    assert sharding.shard_documents(spark.createDataFrame([], SCHEMA), work_dir(spark, "shards")).read().count() == 0


def test_fingerprints_follow_edits(spark, sf_dir):
    rows = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in order_minhash.op9(spark, sf_dir).collect()}
    prints = {}
    for i, (d, text) in enumerate(rows):
        after, n = rows[(i + 1) % len(rows)].text, len(text)
        edited = text[: n - n // 2] + after[: n // 2]
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[d].n_chars == n
        assert prints.setdefault(text, got[d].fingerprint) == got[d].fingerprint
    assert sum(r.near_edited > r.near_next for r in got.values()) > 0.9 * len(got)


def plain_signature(spark, texts, k=2, length=2, bins=64):
    """By hand, from the hashes that SQL gives: k-mers numbered, put on the circle, and for each bin the next ones."""
    grams = {" ".join(w[i : i + k]) if len(w) >= k else " ".join(w) for w in map(brute.words, texts) for i in range(max(1, len(w) - k + 1))} - {""}
    grams = sorted(grams)
    rows = spark.createDataFrame([(g,) for g in grams], "g string").selectExpr("g", f"if(size(split(g, ' ')) >= {k}, xxhash64({', '.join(f'get(split(g, chr(32)), {j})' for j in range(k))}), xxhash64(g)) AS h")
    of = {r.g: r.h for r in rows.collect()}
    numbers = spark.range(200).selectExpr("id AS n").crossJoin(rows).selectExpr("g", "int(n) AS n").collect()
    deep = {(r.h, r.n): r.v for r in spark.createDataFrame([(of[x.g], x.n) for x in numbers], "h long, n int").selectExpr("h", "n", "xxhash64(h, n) AS v").collect()}
    out = []
    for w in map(brute.words, texts):
        own = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
        seen, circle = Counter(), []
        for at, g in enumerate(own):
            v = deep[of[g], seen[g]]
            seen[g] += 1
            circle.append((v % bins, (v & (2**64 - 1)) >> 38, at, of[g]))
        circle.sort()
        picked = []
        for b in range(bins if circle else 0):
            first = next((i for i, x in enumerate(circle) if x[0] >= b), 0)
            some = [circle[(first + j) % len(circle)] for j in range(min(length, len(circle)))]
            picked.append([x[3] for x in sorted(some, key=lambda x: x[2])])
        hashes = spark.createDataFrame([(i, x) for i, x in enumerate(picked)], "b long, x array<long>").selectExpr("b", "xxhash64(x) & 4294967295 AS y").collect()
        out.append({(r.b << 32) | r.y for r in hashes})
    return out


def test_signature_against_a_plain_version(spark):
    texts = ["a b c a b d a b c a b e f g a b", "a", "a b", "a b c", "", "x y " * 40, " ".join(f"w{i}" for i in range(150)), "a a a a a a"]
    for length, bins in ((2, 64), (3, 8)):
        found = order_minhash.signed(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "text", "s", length=length, bins=bins).orderBy("i").collect()
        assert [set(r.s) for r in found] == plain_signature(spark, texts, length=length, bins=bins)
        assert [len(r.s) for r in found] == [bins if t.strip() else 0 for t in texts]


def test_likeness_falls_with_order_at_every_length(spark):
    import random

    rng, rows = random.Random(4), []
    for n in (20, 40, 100, 400, 2000):
        for _ in range(60):
            w = [f"v{rng.randrange(10**6)}" for _ in range(n)]
            rows.append((n, " ".join(w), " ".join(w[n // 2 :] + w[: n // 2])))
    df = order_minhash.signed(order_minhash.signed(spark.createDataFrame(rows, "n int, a string, b string"), "a", "x"), "b", "y")
    found: dict = {}
    for r in df.select("n", order_minhash.likeness(df.x, df.y).alias("like")).collect():
        found.setdefault(r.n, []).append(r.like)
    # every k-mer but one is kept, and half of all pairs keep their order
    means = {n: sum(x) / len(x) for n, x in found.items()}
    assert all(0.35 < x < 0.6 for x in means.values()), means


def test_fingerprints_on_odd_rows(spark):
    rows = order_minhash.fingerprints(spark.createDataFrame(ODD, SCHEMA), rows_in_range=2).collect()
    assert len(rows) == 7
    assert order_minhash.fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
    lone = order_minhash.fingerprints(spark.createDataFrame([(3, "abcd")], "doc_id long, text string")).first()
    assert lone.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and lone.near_next == 1.0


def test_urls(spark):
    urls = [None, "", "nothing", "http://Casino.example.com", "ftp://a.b/free-win", "http://a.b/freewin?ads", "://x.NET/de/8", "http://example.net/de/8x", "http://net/de/", "http://knet/de/", "http://a.example.com/en/70", "http://x.com/en/1?sex=porn"]
    got = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [got[i].verdict for i in range(len(urls))] == ["allow", "allow", "allow", "block", "block", "allow", "allow", "block", "allow", "allow", "allow", "block"]
    assert [got[i].rule for i in (6, 7, 8, 9, 10, 11)] == ["net/de/", "example.net/de/8", "net/de/", None, "example.com/en/7", "com/en/"]
    assert (got[0].host, got[0].path, got[3].host) == ("", "", "casino.example.com")


def test_url_vocabulary_from_a_table(spark):
    table = spark.createDataFrame([("Bad", 3), ("meh", 1), ("so-so", 1), ("ok", 1), ("bad", 2), (None, 9), ("", 9), ("off", 0)], "term string, weight int")
    known = url_filter.read_vocabulary(table)
    assert known == {"bad": 3, "meh": 1, "so-so": 1, "ok": 1}
    urls = ["http://x/meh/meh/MEH", "http://x/meh-so-so", "http://x/meh-so-so?ok", "http://x/bad", "http://x/badly", "off", "x" * 200_000 + "/bad"]
    found = url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), known, 3, ())
    assert [(r.verdict, r.weight) for r in sorted(found.collect())] == [("allow", 1), ("allow", 2), ("block", 3), ("block", 3), ("allow", 0), ("allow", 0), ("block", 3)]
    assert {r.verdict for r in url_filter.filter_urls(spark.createDataFrame([(1, "http://a.com/porn")], "page_id long, url string"), {}).collect()} == {"allow"}


def test_urls_on_odd_rows(spark):
    rows = [(1, "http://a/casino", "x", "y"), (1, "http://a/casino", "x", "y"), (None, None, "x", "y"), (None, "", "x", "y"), (2, "http://" + "a/" * 100_000, "x", "y")]
    docs = spark.createDataFrame(rows, "page_id long, url string, verdict string, host string")
    found = url_filter.filter_urls(docs).collect()
    assert sorted(str((r.page_id, r.verdict)) for r in found) == sorted(map(str, [(1, "block"), (1, "block"), (None, "allow"), (None, "allow"), (2, "allow")]))
    assert max(len(r.path) for r in found) == 200_000 - 1
    assert url_filter.filter_urls(docs.limit(0)).count() == 0
