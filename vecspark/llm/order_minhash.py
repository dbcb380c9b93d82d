"""Order MinHash of texts: signatures that follow edit distance.

After Marçais, DeBlasio, Pandey and Kingsford (2019): number the occurrences of every k-mer of words, so that a
repeated one counts as many; take the minimal ones under a hash; keep them in text order; hash each tuple.
One hash puts the numbered k-mers on a circle cut into `bins`, so a text is hashed and sorted once rather than once for
each tuple: a bin's tuple is the `length` first k-mers from its beginning on, whether in the bin or beyond it. So every
tuple of a text with as many k-mers has `length` of them and tells their order, however short the text. Two texts agree
in a bin when they share its k-mers and their order.

Everything is column expressions on arrays of longs. Texts move once, into ranges of doc_id, which puts almost
every next document beside its predecessor; the first row of each range goes to the range before it as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecspark.llm import native
from vecspark.llm.shared import load

#: Words in a k-mer, k-mers in a tuple, and tuples in a signature.
K, LENGTH, BINS = 2, 2, 64


def signed(df: DataFrame, text: str, out: str, k: int = K, length: int = LENGTH, bins: int = BINS) -> DataFrame:
    """df with the signature of a text column: for each bin a long of its number and the 32-bit hash of its tuple.

    A text with fewer than k words has all its words as its only k-mer; one without any has no tuple at all.
    """
    words, hashes, packed, picked, round_ = (f"_{out}_{x}" for x in ("words", "hashes", "sorted", "picked", "round"))
    h, s, p = F.col(hashes), F.col(packed), F.col(picked)
    one = df.withColumn(words, native.word_array(F.coalesce(F.col(text), F.lit(""))))
    short = F.when(F.size(words) > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))
    two = one.withColumn(hashes, F.when(F.size(words) < k, short).otherwise(native.window_hashes(words, k))).drop(words)
    three = two.withColumn(packed, native.sorted_with_positions(hashes))

    def first_of_run(x: Column, i: Column) -> Column:
        before = F.get(s, i - 1)
        return F.coalesce(F.shiftright(x, native.POSITION_BITS) != F.shiftright(before, native.POSITION_BITS), F.lit(True))

    at = f"_{out}_at"
    runs = F.filter(F.transform(s, lambda x, i: F.when(first_of_run(x, i), i)), lambda i: i.isNotNull())
    four = three.withColumn(at, runs)

    def numbered(start: Column, r: Column) -> Column:
        """The run's occurrences: bin, hash and position in one long; equal k-mers get hashes by their number."""
        end = F.coalesce(F.get(F.col(at), r + 1), F.size(s))
        return F.transform(F.sequence(start, end - 1), lambda j: _binned(F.get(s, j), j - start, h, bins))

    five = four.withColumn(picked, F.sort_array(F.flatten(F.transform(F.col(at), numbered)))).drop(packed, at)
    bin_of = lambda x: F.shiftright(x, 56)
    starts = F.filter(F.transform(p, lambda x, i: F.when(F.coalesce(bin_of(F.get(p, i - 1)) != bin_of(x), F.lit(True)), i)), lambda i: i.isNotNull())
    six = five.withColumn(at, starts).withColumn(round_, F.concat(p, F.slice(p, 1, length - 1)))
    own_length = F.least(F.lit(length), F.size(p))

    def tuples(start: Column, r: Column) -> Column:
        """The tuple from a filled bin on, for it and for the empty bins before it; those after the last have the first's."""
        own = F.slice(F.col(round_), start + 1, own_length)
        in_order = F.transform(F.sort_array(F.transform(own, native.position)), lambda i: F.get(h, i))
        low = F.xxhash64(in_order).bitwiseAND(F.lit(0xFFFFFFFF))
        before = F.when(r > 0, bin_of(F.get(p, start - 1))).otherwise(bin_of(F.element_at(p, -1)) - bins)
        return F.transform(F.sequence(before + 1, bin_of(F.get(p, start))), lambda b: F.shiftleft(F.pmod(b, F.lit(bins)), 32).bitwiseOR(low))

    return six.withColumn(out, F.flatten(F.transform(F.col(at), tuples))).drop(picked, at, hashes, round_)


def _binned(packed: Column, number: Column, hashes: Column, bins: int) -> Column:
    """7 bits of bin, 26 of hash and 30 of position; the sign bit stays free."""
    where = native.position(packed)
    v = F.xxhash64(F.get(hashes, where), number)
    bin_bits = F.shiftleft(F.pmod(v, F.lit(bins)), 56)
    rank = F.shiftleft(F.shiftrightunsigned(v, 38), native.POSITION_BITS)
    return bin_bits.bitwiseOR(rank).bitwiseOR(where.cast("long"))


def as_text(signature: str) -> Column:
    """10 hex digits for each bin: its number and its hash."""
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x), 10, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of bins with equal tuples; 1 where both texts are without tuples, 0 where one is."""
    filled = F.greatest(F.size(a), F.size(b))
    return F.when(filled > 0, F.size(F.array_intersect(a, b)).cast("double") / filled).otherwise(F.lit(1.0))


def range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most the key, by two short scans."""
    step = max(1, int(len(bounds) ** 0.5))
    coarse, fine = F.array(*map(F.lit, bounds[::step])).cast("array<bigint>"), F.array(*map(F.lit, bounds)).cast("array<bigint>")
    skipped = F.greatest(F.size(F.filter(coarse, lambda b: b <= key)) - 1, F.lit(0)) * step
    return skipped + F.size(F.filter(F.slice(fine, skipped + 1, step), lambda b: b <= key))


def ranged(docs: DataFrame, rows_in_range: int, most_ranges: int) -> DataFrame:
    """docs(doc_id, text) with _range, _extra and _key: each range ends with the row that follows it, as an extra.

    The bounds are approximate quantiles of the ids; what is collected is one id for each range.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    ids = docs.select(key.alias("_key"))
    n = max(1, min(most_ranges, ids.count() // rows_in_range))
    shares = [i / n for i in range(1, n)]
    bounds = sorted(set(ids.agg(F.percentile_approx("_key", shares, 20 * n)).first()[0] or [])) if shares else []
    keyed = docs.withColumn("_key", key).withColumn("_range", range_of(F.col("_key"), bounds) if bounds else F.lit(0))
    firsts = [(r["_range"], r["_first"]) for r in keyed.groupBy("_range").agg(F.min("_key").alias("_first")).orderBy("_range").collect()]
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}
    extra = docs.sparkSession.createDataFrame([(k, r) for k, r in before.items()], "_key long, _also int")
    met = keyed.join(F.broadcast(extra), "_key", "left")
    copies = F.when(F.col("_also").isNull(), F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("x")))).otherwise(
        F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("x")), F.struct(F.col("_also").alias("r"), F.lit(True).alias("x")))
    )
    return met.withColumn("_copy", F.explode(copies)).select(*docs.columns, "_key", F.col("_copy.r").alias("_range"), F.col("_copy.x").alias("_extra"))


def fingerprints(docs: DataFrame, k: int = K, length: int = LENGTH, bins: int = BINS, rows_in_range: int = 250, most_ranges: int = 20_000) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of docs(doc_id, text).

    The edited text has the last floor(n_chars / 2) code points replaced by as many of the next document's first,
    or all it has. Next is by ascending doc_id, null first, then text; the last one's next is the first, and a
    lone document's is itself. A null text is empty. Two empty texts have likeness 1, an empty and another 0.
    """
    rows = ranged(docs.select("doc_id", native.text_or_empty().alias("text")), rows_in_range, most_ranges).repartition("_range")
    rows = signed(rows, "text", "_own", k, length, bins)
    follow = W.partitionBy("_range").orderBy("_extra", "_key", "text")
    rows = rows.withColumn("_next", F.lead(F.struct("text", "_own")).over(follow)).where("not _extra")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("_next.text"), F.lit(1), half))
    rows = signed(rows.withColumn("_edited", edited), "_edited", "_other", k, length, bins)
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        as_text("_own").alias("fingerprint"),
        as_text("_other").alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_other")).alias("near_edited"),
        likeness(F.col("_own"), F.col("_next._own")).alias("near_next"),
    )


def op9(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints(load(spark, sf_dir, "documents"))
