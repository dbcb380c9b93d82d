"""Exact Jaccard self-join on word shingles: size-aware, heavy and light.

Small sets meet by *enumerated subsets*: two sets that are similar enough share a subset of a size fixed by the
larger one, so each small set lists its subsets of every admissible size and equal subsets meet. Large sets meet
on *inverted lists*: of a set with n elements, any partner holds one of the first n - ceil(t n) + 1 in a common
order, so only these are posted, and the lists are scanned. The boundary is where, by `list_cost`, posting and
scanning becomes cheaper than enumerating; sets just below it are posted as well, so that pairs across it meet.

Before two texts are compared, so are their parity sketches: as many bits as differ, as many elements at least
does the one set hold that the other doesn't, so pairs with too many are out.

The common order puts shingles that many documents of some block repeat last. It only decides how long the
lists get: any order gives every link.

What is asked for is which documents hang together, so within a list only pairs that can still join two groups
are checked: first each member against the list's smallest document, then, where members of one list lie in
different components, every pair across these. Links between documents that already hang together add nothing.
Of a light list these pairs become rows. A heavy one is cut into chunks of sets of like sizes, and each two chunks that
may hold links meet in one task that compares the sketches in memory and returns the few pairs left, so no list makes
rows as its square.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm.components import connected_components
from vecspark.llm.shared import Scratch
from vecspark.llm.tokens import Words, blocks, longs, mixed, ragged, rolled, texts

#: Entries of the table of common shingles, which is broadcast: at most 262,144 longs and ranks, 4 MB.
COMMON_LIMIT = 262_144
#: Document ids that are broadcast at most (16 MB) to fetch texts to compare; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Members up to which a list's pairs become rows, and members of a chunk of a longer list.
LIGHT_LIST, CHUNK = 32, 1024
#: Pairs of one document that meet its text in one part.
HUB_PAIRS = 64
#: Bits of a parity sketch at most; a larger set's is only less telling.
SKETCH_BITS = 1 << 16


def least_overlap(n: int, percent: int) -> int:
    """Elements that a set of n shares at least with any set of that similarity."""
    return -(-percent * n // 100)


def prefix_length(n: int, percent: int) -> int:
    return n - least_overlap(n, percent) + 1


def boundary(percent: int, list_cost: int) -> int:
    """The largest size up to which enumerating costs no more than posting and scanning.

    The cost of either is a sum over sets, so the best boundary does not depend on how many sets have a size. Equal sets
    have one subset to list, the set itself, whatever its size.
    """
    if percent >= 100:
        return 1 << 40
    n = 0
    while sum(comb(n + 1, c) for c in range(least_overlap(n + 1, percent), n + 2)) <= list_cost * prefix_length(n + 1, percent):
        n += 1
    return n


def shingle_hashes(words: Words, k: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each document, sorted; a shorter document's is that of all its words."""
    rolling, out = rolled(words.hashes, k), []
    for start, end, n in zip(words.starts, words.ends, words.lens, strict=True):
        if n >= k:
            out.append(np.unique(rolling[start : end - k + 1]))
        elif n:
            out.append(mixed(rolled(words.hashes[start:end], int(n)) + np.uint64(n)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def shingle_set(text: bytes, k: int) -> frozenset:
    """The shingles themselves."""
    words = text.lower().split()
    if len(words) < k:
        return frozenset([tuple(words)] if words else [])
    return frozenset(zip(*(words[j:] for j in range(k)), strict=False))


def parity_sketch(elements: np.ndarray) -> bytes:
    """Bit i is the parity of the elements hashed to i; about four bits an element."""
    bits = min(SKETCH_BITS, 1 << max(6, int(4 * len(elements) - 1).bit_length()))
    at = mixed(elements + np.uint64(1)) & np.uint64(bits - 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def sketch_distance(x: bytes, y: bytes) -> int:
    """A lower bound of the size of the symmetric difference; the longer sketch is folded."""
    a, b = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    return int(np.bitwise_count(np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0) ^ a).sum())


def common_shingles(docs: DataFrame, k: int, scratch: Scratch) -> np.ndarray:
    """Shingles that some block of texts repeats across documents, most frequent last.

    Each block sends those that it holds twice or more, with counts; the table keeps the most frequent ones, COMMON_LIMIT
    at most and none of a count that would exceed it, as it only orders. A histogram of the counts says from which on,
    so that no task sends more than it has of them.
    """

    def scan(batches):
        for batch in batches:
            for block in blocks(batch):
                found = shingle_hashes(Words(texts(block), lower=True), k)
                values, counts = np.unique(np.concatenate(found), return_counts=True)
                often = counts >= 2
                if often.any():
                    yield pa.RecordBatch.from_arrays([longs(values[often]), pa.array(counts[often])], names=["h", "c"])

    sent = docs.select("text").mapInArrow(scan, "h long, c long")
    counted = scratch.put(sent.groupBy("h").agg(F.sum("c").alias("c")), "common")
    # counts from 4,096 on are told apart by their bits only, so that there are few
    level = F.when(F.col("c") < 4096, F.col("c")).otherwise(4096 + F.floor(F.log2("c") * 64))
    least, total = None, 0
    for value, n in sorted(((r["level"], r["n"]) for r in counted.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True):
        total += n
        if total > COMMON_LIMIT:
            break
        least = value
    top = counted.where(level >= least).toPandas() if least is not None else None
    scratch.drop("common")
    return np.zeros(0, np.uint64) if top is None else top.sort_values(["c", "h"], ascending=[True, False])["h"].to_numpy(dtype=np.int64).view(np.uint64).copy()


def signatures(docs: DataFrame, k: int, percent: int, list_cost: int, scratch: Scratch) -> DataFrame:
    """(doc_id, n, s1, s2, keys, sketch): the set's size, its 128-bit hash, the keys under which it meets others
    and its parity sketch."""
    common = common_shingles(docs, k, scratch)
    by_hash = np.argsort(common)
    shared = docs.sparkSession.sparkContext.broadcast((common[by_hash], by_hash))
    small = boundary(percent, list_cost)
    posted_from = least_overlap(small + 1, percent)

    def ordered(elements: np.ndarray) -> np.ndarray:
        values, ranks = shared.value
        if not len(values):
            return elements
        at = np.searchsorted(values, elements)
        at[at == len(values)] = 0
        hit = values[at] == elements
        return np.concatenate([elements[~hit], elements[hit][np.argsort(ranks[at[hit]])]]) if hit.any() else elements

    def keys(elements: np.ndarray) -> np.ndarray:
        n, out = len(elements), []
        if 0 < n <= small:
            own = mixed(elements)
            with np.errstate(over="ignore"):
                for c in range(least_overlap(n, percent), n + 1):
                    out += [mixed(own[list(x)].sum() + np.uint64(c)) for x in combinations(range(n), c)]
            out = [np.array(out, dtype=np.uint64)]
        if n >= posted_from:
            out.append(ordered(elements)[: prefix_length(n, percent)])
        return (np.concatenate(out) if out else elements).view(np.int64)

    def scan(batches):
        for batch in batches:
            for block in blocks(batch):
                sets = shingle_hashes(Words(texts(block), lower=True), k)
                sums = [np.array([mixed(s).sum(), mixed(s * np.uint64(0xD6E8FEB86659FD93)).sum()], dtype=np.uint64) for s in sets]
                pair = np.array(sums).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        block.column("doc_id").cast(pa.int64()),
                        pa.array(np.array([len(s) for s in sets], dtype=np.int64)),
                        longs(pair[:, 0]),
                        longs(pair[:, 1]),
                        ragged([keys(s) for s in sets]),
                        pa.array([parity_sketch(s) for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "n", "s1", "s2", "keys", "sketch"],
                )

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, n long, s1 long, s2 long, keys array<long>, sketch binary")


def plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sketches don't rule the similarity out."""
    sizes = nodes.select("doc_id", "n")
    pairs = (
        pairs.join(sizes.select(F.col("doc_id").alias("a"), F.col("n").alias("na")), "a")
        .join(sizes.select(F.col("doc_id").alias("b"), F.col("n").alias("nb")), "b")
        .where(f"100 * least(na, nb) >= {int(percent)} * greatest(na, nb)")
        .select("a", "b")
        .distinct()
    )
    rows = pairs.join(nodes.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a").join(
        nodes.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b"
    )

    def check(batches):
        for batch in batches:
            most = (100 - percent) * (np.asarray(batch.column("na")) + np.asarray(batch.column("nb")))
            far = map(sketch_distance, batch.column("sa").to_pylist(), batch.column("sb").to_pylist())
            keep = np.fromiter(far, np.int64, batch.num_rows) * (100 + percent) <= most
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return rows.select("a", "b", "na", "sa", "nb", "sb").mapInArrow(check, "a long, b long").distinct()


def size_band(percent: int):
    """A number for the size n of a set, such that sets that are similar enough are of one band or of two next ones.

    Bands are a little wider than the similarity allows, so that no rounding can part two sizes further.
    """
    return F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent * (1 + 1e-6))) if percent < 100 else F.col("n")


def heavy_pairs(lists: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Plausible pairs (a, b) across components of lists(key, id, n, component).

    Each band of sizes of a list is cut into chunks, and a chunk meets those of its own band and of the next. So a
    member goes to as many cells as these bands have chunks, rather than all of the list.
    """
    banded = lists.join(nodes.select(F.col("doc_id").alias("id"), "sketch"), "id").withColumn("band", size_band(percent).cast("long"))
    parts = banded.groupBy("key", "band").agg(F.ceil(F.count("*") / CHUNK).cast("long").alias("parts"))
    near = parts.withColumn("step", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    # for each band of a list: the bands it meets and their chunks
    near = near.select("key", (F.col("band") + F.col("step")).alias("band"), F.struct(F.col("band").alias("of"), "parts").alias("x")).groupBy("key", "band").agg(F.collect_list("x").alias("near"))
    own_parts = F.filter("near", lambda x: x["of"] == F.col("band"))[0]["parts"]
    chunk = lambda band, i: F.shiftleft(band, 32) + i
    cells = (
        banded.join(near, ["key", "band"])
        .withColumn("own", chunk(F.col("band"), F.pmod(F.xxhash64("id"), own_parts)))
        .withColumn("other", F.explode(F.flatten(F.transform("near", lambda x: F.transform(F.sequence(F.lit(0).cast("long"), x["parts"] - 1), lambda i: chunk(x["of"], i))))))
        .select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "n", "component", "sketch")
    )

    def compare(table: pa.Table) -> pa.Table:
        ids, n, comp, own = (np.asarray(table.column(x)) for x in ("id", "n", "component", "own"))
        sketch = [np.frombuffer(x, np.uint8) for x in table.column("sketch").to_pylist()]
        size = np.array([len(x) for x in sketch])
        same = table.column("lo")[0] == table.column("hi")[0]
        a, b = [], []
        for width in np.unique(size):  # each pair is met once, at the width of its shorter sketch
            wide = np.flatnonzero(size >= width)
            folded = np.array([np.bitwise_xor.reduce(sketch[x].reshape(-1, width), axis=0) for x in wide])
            for x in np.flatnonzero(size == width):
                ok = (comp[wide] != comp[x]) & (100 * np.minimum(n[wide], n[x]) >= percent * np.maximum(n[wide], n[x]))
                ok &= (size[wide] > width) | (ids[wide] > ids[x])
                if not same:
                    ok &= own[wide] != own[x]
                left = np.flatnonzero(ok)
                far = np.bitwise_count(folded[left] ^ sketch[x]).sum(axis=1, dtype=np.int64)
                left = left[far * (100 + percent) <= (100 - percent) * (n[wide[left]] + n[x])]
                a.append(np.minimum(ids[wide[left]], ids[x]))
                b.append(np.maximum(ids[wide[left]], ids[x]))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return cells.groupBy("key", "lo", "hi").applyInArrow(compare, "a long, b long").distinct()


def with_texts(pairs: DataFrame, held: DataFrame, own: str, other: str, scratch: Scratch, name: str) -> DataFrame:
    """pairs with the texts of one end as t + own.

    A document with more than HUB_PAIRS pairs is met in parts, by a hash of the other end, and its text goes to each.
    """
    hubs = pairs.groupBy(own).agg(F.count("*").alias("c")).where(F.col("c") > HUB_PAIRS)
    hubs = scratch.put(hubs.select(own, F.ceil(F.col("c") / HUB_PAIRS).cast("int").alias("parts")), f"{name}_{own}")
    salted = pairs.join(hubs, own, "left").withColumn("salt", F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    said = held.select(F.col("doc_id").alias(own), F.col("text").alias(f"t{own}")).join(hubs, own, "left")
    said = said.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return salted.join(said, [own, "salt"]).drop("salt")


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """Those of the written pairs (a, b) whose texts are similar enough, by the shingles themselves."""
    wanted = scratch.put(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct(), name)
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    held = docs.join(wanted, "doc_id", "left_semi")
    rows = with_texts(with_texts(pairs, held, "b", "a", scratch, name), held, "a", "b", scratch, name)

    def check(batches):
        cached = lru_cache(64)(lambda text: shingle_set(text, k))
        for batch in batches:
            for block in blocks(batch, "tb"):
                keep = []
                for ta, tb in zip(texts(block, "ta"), texts(block, "tb"), strict=True):
                    x, y = cached(ta), shingle_set(tb, k)
                    both = len(x & y)
                    keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                yield block.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long").distinct()


def similar_groups(docs: DataFrame, k: int = 5, percent: int = 80, list_cost: int = 16) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs(doc_id, text).

    A-Z are lower-cased. Two documents link when 100 * |intersection| >= percent * |union| of their sets of
    k-word shingles; one with fewer words has its whole sequence as its only shingle, one without words or
    text has none and links with nothing. component_id is the smallest doc_id reachable, the document's own
    included. Rows with equal sets form one node with the smallest of their ids; rows that repeat a doc_id are
    kept. A null doc_id has the component of its equal sets, or null. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scratch = Scratch(docs.sparkSession, "jaccard")
    numbered = signatures(docs, k, percent, list_cost, scratch).withColumn("row", F.monotonically_increasing_id())
    signed = scratch.put(numbered, "signatures")
    slim = scratch.put(signed.select("doc_id", "n", "s1", "s2", "row"), "sets")
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row"))).alias("least")
    reps = slim.where("n > 0").groupBy("s1", "s2").agg(least).select("s1", "s2", F.col("least.doc_id").alias("rep"), F.col("least.row").alias("row"))
    nodes = scratch.put(signed.join(reps.select("row"), "row", "left_semi").select("doc_id", "n", "keys", "sketch"), "nodes")
    scratch.drop("signatures")

    posted = nodes.select(F.explode("keys").alias("key"), F.col("doc_id").alias("id"), "n")
    met = posted.groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("hub")).where("c > 1").select("key", "hub")
    met = scratch.put(met, "met")
    lists = scratch.put(posted.join(met, "key"), "lists")
    scratch.drop("met")

    star = scratch.put(lists.where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "star")
    sketched = nodes.select("doc_id", "n", "sketch")
    near = scratch.put(plausible(star, sketched, percent), "near")
    links = scratch.put(verified(near, docs, k, percent, scratch, "ids"), "links")
    groups = connected_components(links)

    held = lists.join(groups, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("component"))
    open_keys = (
        held.groupBy("key").agg(F.count("*").alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("key", "c")
    )
    open_lists = scratch.put(held.join(open_keys, "key"), "open")
    scratch.drop("lists", "near", "ids")
    light = open_lists.where(F.col("c") <= LIGHT_LIST)
    across = (
        light.select("key", F.col("id").alias("a"), "n", F.col("component").alias("ca"))
        .join(light.select("key", F.col("id").alias("b"), F.col("n").alias("m"), F.col("component").alias("cb")), "key")
        .where("ca < cb")
        .where(f"100 * least(n, m) >= {int(percent)} * greatest(n, m)")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
        .join(star, ["a", "b"], "left_anti")
    )
    heavy = heavy_pairs(open_lists.where(F.col("c") > LIGHT_LIST), sketched, percent)
    rest = plausible(across, sketched, percent).union(heavy).distinct().join(star, ["a", "b"], "left_anti")
    rest = scratch.put(rest, "rest")
    more = scratch.put(verified(rest, docs, k, percent, scratch, "more_ids"), "more")
    if not more.isEmpty():
        groups = connected_components(links.union(more))

    named = reps.join(groups.withColumnRenamed("id", "rep"), "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("component"))
    found = slim.join(named, ["s1", "s2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id")
    )
    return scratch.result(found, "groups")


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without the documents that hang together with one of a smaller doc_id; rows without an id stay."""
    groups = similar_groups(docs, k, percent)
    dropped = groups.where("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(dropped, docs["doc_id"] == dropped["_gone"], "left_anti")


def op10(spark, sf_dir: str) -> DataFrame:
    """Groups of documents whose 3-word shingles have a Jaccard similarity of 0.9 or more."""
    from vecspark.llm.shared import load

    return similar_groups(load(spark, sf_dir, "documents"), k=3, percent=90)
