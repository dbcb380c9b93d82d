"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

1. Targets: every source gets words by weight, but no more than `most_repeats` times its own; what is over goes to
   the others by weight until none is above (a water level, found in one pass over the sources by cap/weight).
2. The mix is cut into blocks of `block_words`. Sources get blocks by the highest quotients target / (2 k + 1),
   k = 0, 1, ...; within a source, cells of shards and then shards do in the same way, in proportion to their words.
3. Within a shard the documents stand in a seeded order, and the quota takes whole rounds and then the first
   blocks of this order. So a document is taken whole, twice, in part or not at all.

A source is dealt into shards of about `shard_words`, so the order is never that of a whole source; sums leave
the map side as one row for each source and shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecspark.llm import native
from vecspark.llm.shared import load, written

#: By rank of the source; share of all sizes, and the most repeats, in percent.
WEIGHTS, SHARE, MOST_REPEATS = (5, 2, 1), 150, 200
BLOCK_WORDS, SHARD_WORDS, CELL, SEED = 16, 65_536, 1024, 17


def targets(sizes: DataFrame, weights=WEIGHTS, share: int = SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, rank, target) of sizes(source, size), a row for each source."""
    ranked = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ranked = ranked.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("source_size") * most
    by_level = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    return (
        ranked.withColumn("weight", weight.cast("long"))
        .withColumn("cap", cap)
        .withColumn("all", F.sum("source_size").over(W.partitionBy()))
        .withColumn("spent", F.coalesce(F.sum("cap").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("left", share * F.col("all") - F.col("spent"))
        .withColumn("open", F.col("cap") * F.col("left_weight") >= F.col("weight") * F.col("left"))
        .withColumn("level", F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "rank", "left", "left_weight"))).over(W.partitionBy()))
        .withColumn(
            "target",
            F.when(F.struct(F.col("cap") / F.col("weight"), "rank") < F.struct("level.col1", "level.rank"), F.col("cap") / 100.0).otherwise(
                F.col("weight") * F.col("level.left") / (100.0 * F.col("level.left_weight"))
            ),
        )
        .select("source", "source_size", "rank", "target")
    )


def apportioned(claims: DataFrame, groups: list[str], key: str, seats: str, seats_in: str = "wanted") -> DataFrame:
    """claims(groups, key, votes) with seats: Sainte-Laguë, seats_in whole seats in each group.

    Rounding votes times seats over the group's votes misses the right seats by less than n * share / 2 + 1
    for a group of n (shares sum to 1), so only quotients that near to the edge are ranked: about 3 n rows.
    """
    whole = W.partitionBy(*groups)
    quota = F.when(F.col("_sum") > 0, F.col("votes") * F.col(seats_in) / F.col("_sum")).otherwise(F.lit(0.0))
    slack = F.when(F.col("_sum") > 0, F.ceil(F.col("_n") * F.col("votes") / (2 * F.col("_sum")))).otherwise(F.lit(0)) + 2
    near = (
        claims.withColumn("_sum", F.sum("votes").over(whole))
        .withColumn("_n", F.count("*").over(whole))
        .withColumn("_near", F.floor(quota + 0.5))
        .withColumn("_slack", slack)
        .withColumn("_sure", F.when(F.col("votes") > 0, F.greatest(F.lit(0), F.col("_near") - F.col("_slack"))).otherwise(F.lit(0)))
    )
    left = near.withColumn("_left", F.col(seats_in) - F.sum("_sure").over(whole))
    tried = left.withColumn("_k", F.explode(F.sequence(F.col("_sure"), F.col("_near") + F.col("_slack"))))
    best = W.partitionBy(*groups).orderBy((F.col("votes") / (2 * F.col("_k") + 1)).desc(), key)
    won = (F.col("votes") > 0) & (F.row_number().over(best) <= F.col("_left"))
    scored = tried.withColumn("_won", F.when(won, F.lit(1)).otherwise(F.lit(0)))
    kept = [c for c in claims.columns if c not in (*groups, key)]
    return scored.groupBy(*groups, key).agg(
        *[F.first(c).alias(c) for c in kept], (F.first("_sure") + F.sum("_won")).cast("long").alias(seats)
    )


def measured(docs: DataFrame) -> tuple[DataFrame, dict]:
    """docs with its columns renamed, and size (words), source and spread (doc_id, or of a null one a digest of the
    text); and its columns by their own names."""
    renamed, own = native.aside(docs)
    text = F.coalesce(own["text"], F.lit(""))
    digest = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    spread = F.coalesce(own["doc_id"].cast("long"), digest)
    return renamed.withColumns({"source": own["source"], "size": native.word_count(text), "spread": spread}), own


def quotas(sizes: DataFrame, weights=WEIGHTS, share: int = SHARE, most: int = MOST_REPEATS, block: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """A row for each source (source, source_size, rank, target, blocks, n_shards), and for each shard (rank, shard,
    votes, words) its words and those of them, with repeats, that the mix takes.

    A source's blocks go to cells of CELL shards, and a cell's to its shards, so no window holds all shards of a source.
    """
    named = targets(sizes, weights, share, most)
    total = named.withColumn("wanted", F.floor(F.sum("target").over(W.partitionBy()) / block).cast("long"))
    sources = apportioned(total.withColumn("votes", F.col("target")).withColumn("_all", F.lit(0)), ["_all"], "rank", "blocks")
    n_shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long")
    sources = written(sources.select("source", "source_size", "rank", "target", "blocks", n_shards.alias("n_shards")), "quotas")
    by_shard = dealt(sizes, sources).groupBy("rank", "shard").agg(F.sum("size").alias("votes"), F.first("blocks").alias("blocks"))
    shards = written(by_shard.withColumn("cell", F.floor(F.col("shard") / CELL)), "shards")
    cells = shards.groupBy("rank", "cell").agg(F.sum("votes").alias("votes"), F.first("blocks").alias("wanted"))
    cells = apportioned(cells, ["rank"], "cell", "owned").select("rank", "cell", F.col("owned").alias("wanted"))
    shards = apportioned(shards.drop("blocks").join(cells, ["rank", "cell"]), ["rank", "cell"], "shard", "own")
    words = F.least(F.col("own") * block, F.floor(F.col("votes") * most / 100))
    return sources, written(shards.select("rank", "shard", "votes", words.cast("long").alias("words")), "words")


def dealt(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows(source, spread, ...) with the quota of their source and their shard."""
    named = sources.withColumnRenamed("source", "_source")
    return rows.join(named, rows["source"].eqNullSafe(named["_source"])).drop("_source").withColumn("shard", F.pmod("spread", F.col("n_shards")))


def taken(rows: DataFrame, sources: DataFrame, shards: DataFrame, seed: int, *ties: Column) -> DataFrame:
    """rows(source, spread, size, ...) with the quota of their source and taken: whole rounds of the shard, and the
    first words of its seeded order."""
    order = W.partitionBy("rank", "shard").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("spread").cast("string"))), "spread", "size", *ties)
    rounds = F.when(F.col("votes") > 0, F.floor(F.col("words") / F.col("votes"))).otherwise(F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("words") - rounds * F.col("votes") - F.col("_start")))
    return (
        dealt(rows, sources)
        .join(shards, ["rank", "shard"])
        .withColumn("_start", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("taken", (rounds * F.col("size") + part).cast("long"))
    )


def mix(docs: DataFrame, weights=WEIGHTS, share: int = SHARE, most: int = MOST_REPEATS, block: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) of every row of docs(doc_id, text, source).

    Null and empty texts have size 0, a very long one all its words; a null source is a source of its own, ranked last;
    a digest of the text stands for a null doc_id where an order is needed. Rows that repeat a doc_id are rows of their
    own. An empty table has no rows. Other columns are ignored. taken counts words with repeats, at most `most` percent
    of the size; shares and targets are percentages of words.
    """
    rows, own = measured(docs)
    sizes = written(rows.select(own["doc_id"].alias("doc_id"), "source", "size", "spread"), "sizes")
    sources, shards = quotas(sizes, weights, share, most, block, shard_words)
    return taken(sizes, sources, shards, seed).select("doc_id", "size", "source_size", "target", "taken", "source")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share: int = SHARE, most: int = MOST_REPEATS, block: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """docs as the mix takes them: a row once, repeated, cut after its first words, or not at all.

    Each row has its own part of the mix, also where doc_ids repeat or are null: texts move with their rows to their
    shards, and nothing is joined by doc_id. The columns are those of docs, whatever their names; n_chars, if there,
    follows the text.
    """
    rows, own = measured(docs)
    sizes = written(rows.select("source", "size", "spread"), "sizes")
    sources, shards = quotas(sizes, weights, share, most, block, shard_words)
    found = taken(rows, sources, shards, seed, F.xxhash64(*own.values())).where("taken > 0")
    copies = F.transform(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size"))), lambda i: F.least(F.col("size"), F.col("taken") - (i - 1) * F.col("size")))
    whole = native.word_array(F.coalesce(own["text"], F.lit("")))
    cut = F.when(F.col("_take") < F.col("size"), F.array_join(F.slice(whole, 1, F.col("_take").cast("int")), " ")).otherwise(own["text"])
    out = own | {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    found = found.select(*own.values(), "size", F.explode(copies).alias("_take")).withColumn("_text", cut)
    return found.select(*[column.alias(c) for c, column in out.items()])


def op6(spark, sf_dir: str) -> DataFrame:
    """Words taken of every document."""
    return mix(load(spark, sf_dir, "documents"))


def _apportion_sql(name: str, claims: str, groups: str, key: str) -> str:
    """CTEs that add seats to claims(groups, key, votes, wanted)."""
    return f"""{name}_sums AS (
  SELECT *, sum(votes) OVER g AS s, count(*) OVER g AS n FROM {claims} WINDOW g AS (PARTITION BY {groups})
), {name}_near AS (
  SELECT *, CASE WHEN s > 0 THEN floor(votes * wanted / s + 0.5) ELSE 0 END::BIGINT AS near,
         CASE WHEN s > 0 THEN ceil(n * votes / (2 * s)) ELSE 0 END::BIGINT + 2 AS slack FROM {name}_sums
), {name}_sure AS (SELECT *, CASE WHEN votes > 0 THEN greatest(0, near - slack) ELSE 0 END AS sure FROM {name}_near
), {name}_left AS (SELECT *, wanted - sum(sure) OVER (PARTITION BY {groups}) AS lft FROM {name}_sure
), {name}_tried AS (SELECT *, unnest(range(sure, near + slack + 1)) AS k FROM {name}_left
), {name}_won AS (
  SELECT *, CASE WHEN votes > 0 AND row_number() OVER (PARTITION BY {groups} ORDER BY votes / (2 * k + 1) DESC, {key}) <= lft THEN 1 ELSE 0 END AS won
  FROM {name}_tried
), {name} AS (SELECT {groups}, {key}, min(sure) + sum(won) AS seats, any_value(votes) AS votes FROM {name}_won GROUP BY {groups}, {key})"""


OP6_SQL = rf"""
WITH sizes AS (
  SELECT doc_id, coalesce(doc_id, ('0x' || substr(md5(coalesce(text, '')), 1, 8))::BIGINT) AS spread, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sizes GROUP BY source
), weighed AS (
  SELECT *, ([{", ".join(map(str, WEIGHTS))}][((rank - 1) % {len(WEIGHTS)} + 1)::INT])::BIGINT AS weight, source_size * {MOST_REPEATS} AS cap,
         sum(source_size) OVER ()::BIGINT AS total FROM sources
), levels AS (
  SELECT *, {SHARE} * total - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lft,
         sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS left_weight FROM weighed
), level AS (
  SELECT cap / weight AS edge, rank AS at_rank, lft AS at_left, left_weight AS at_weight FROM levels
  WHERE cap * left_weight >= weight * lft ORDER BY cap / weight, rank LIMIT 1
), targets AS (
  SELECT source, source_size, rank, CASE WHEN cap / weight < edge OR (cap / weight = edge AND rank < at_rank) THEN cap / 100.0::DOUBLE
         ELSE (weight * at_left) / (100.0::DOUBLE * at_weight) END AS target FROM levels, level
), claims AS (
  SELECT 0 AS g, rank, target AS votes, floor(sum(target) OVER () / {BLOCK_WORDS})::BIGINT AS wanted FROM targets
), {_apportion_sql("seats", "claims", "g", "rank")},
quotas AS (
  SELECT t.*, seats AS blocks, greatest(1, ceil(source_size / {SHARD_WORDS}))::BIGINT AS n_shards FROM targets t JOIN seats USING (rank)
), docs AS (
  SELECT doc_id, spread, size, source_size, target, rank, blocks, spread % n_shards AS shard, q.source
  FROM sizes s JOIN quotas q ON s.source IS NOT DISTINCT FROM q.source
), shards AS (SELECT rank, shard // {CELL} AS cell, shard, sum(size)::BIGINT AS votes, any_value(blocks)::BIGINT AS wanted FROM docs GROUP BY rank, shard
), cells AS (SELECT rank, cell, sum(votes)::BIGINT AS votes, any_value(wanted) AS wanted FROM shards GROUP BY rank, cell
), {_apportion_sql("celled", "cells", "rank", "cell")},
in_cells AS (SELECT rank, cell, shard, s.votes, c.seats AS wanted FROM shards s JOIN celled c USING (rank, cell)
), {_apportion_sql("owned", "in_cells", "rank, cell", "shard")},
words AS (
  SELECT rank, shard, votes, least(seats * {BLOCK_WORDS}, floor(votes * {MOST_REPEATS} / 100))::BIGINT AS words FROM owned
), placed AS (
  SELECT *, sum(size) OVER (PARTITION BY rank, shard ORDER BY md5(concat_ws(':', '{SEED}', spread::VARCHAR)), spread, size ROWS UNBOUNDED PRECEDING) - size AS start
  FROM docs JOIN words USING (rank, shard)
)
SELECT doc_id, size, source_size, target, source, (CASE WHEN votes > 0 THEN words // votes ELSE 0 END * size
  + greatest(0, least(size, words - CASE WHEN votes > 0 THEN words // votes ELSE 0 END * votes - start)))::BIGINT AS taken FROM placed
"""
