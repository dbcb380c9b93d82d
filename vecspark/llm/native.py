"""Column expressions on words, without Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The six white-space characters between words, \x20 and \x09-\x0D.
SPACE = " \t\n\x0b\x0c\r"
#: A sorted pair of hash and position in one long: 34 bits of the hash, then 30 of the position.
POSITION_BITS = 30
POSITION_MASK = (1 << POSITION_BITS) - 1


def aside(docs: DataFrame, prefix: str = "_in") -> tuple[DataFrame, dict[str, Column]]:
    """docs with its columns renamed by number, and these by their own names: they clash with none that is added."""
    names = {c: f"{prefix}{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), {c: F.col(n) for c, n in names.items()}


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def word_array(text: Column) -> Column:
    """The words of a text, [] if it has none."""
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(F.length(bare) > 0, F.split(bare, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def window_hashes(words: str, k: int) -> Column:
    """64-bit hashes of all windows of k words of an array column, by start."""
    w = F.col(words)
    at = F.sequence(F.lit(0), F.size(w) - k)
    hashed = F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    return F.when(F.size(w) >= k, hashed).otherwise(F.array().cast("array<bigint>"))


def sorted_with_positions(hashes: str) -> Column:
    """hash and position packed into longs and sorted, which Spark does on primitive arrays."""
    packed = F.transform(F.col(hashes), lambda h, i: F.shiftleft(h, POSITION_BITS).bitwiseOR(i.cast("long")))
    return F.sort_array(packed)


def position(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(POSITION_MASK)).cast("int")
