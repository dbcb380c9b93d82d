"""Removal of word sequences that occur earlier in the corpus, by suffix automata of reference shards.

Automata of the whole corpus would have to meet every document, so the corpus is cut into reference shards by
content. Of each window of `window` words, the smallest hash among its k-word grams is its anchor: equal windows
have the same anchor at the same place. Runs of windows with one anchor are fragments of a document; an anchor's
fragments, in document order, are a reference shard. Only anchors that occur twice get one. Each shard streams
its fragments: the automaton of those before gives the matching statistics of the next, windows matched in full
are repeats, others are first occurrences, and a fragment with any of these is added to the automaton. So the
shards go to the documents' fragments by a shuffle of what may repeat, rather than by broadcast to all documents.

Copies of a whole text are found first, by a hash of its words, and send nothing. Within a task, equal fragments
travel once. The windows of an anchor that occurs more than `HEAVY` times, as in a passage that many documents hold,
are no shard: the first occurrence of each is found by an aggregation, which combines on the map side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecspark.llm import native
from vecspark.llm.shared import Scratch, load
from vecspark.llm.suffix_automaton import SuffixAutomaton
from vecspark.llm.tokens import Words, blocks, mixed, ragged, rolled, texts

#: Words of a gram that can be an anchor; occurrences from which an anchor's shard is cut.
GRAM, HEAVY = 6, 500
#: Fragments that a task gathers before it sends them.
MOST_SENT = 30_000
#: From where documents without an id are numbered, by their texts; ids are below it.
FIRST_UNNAMED = 2**62


def fragments(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all runs of windows with one anchor: document, anchor hash, start of the first window, windows."""
    grams = rolled(words.hashes, gram)
    n = len(words.hashes) - window + 1
    if n <= 0:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty.view(np.uint64), empty, empty
    least, at = grams[:n].copy(), np.arange(n)
    for j in range(1, window - gram + 1):
        lower = grams[j : j + n] < least
        least[lower] = grams[j : j + n][lower]
        at[lower] = np.flatnonzero(lower) + j
    doc = np.repeat(np.arange(len(words.lens)), words.lens)[:n]
    whole = np.arange(n) + window <= words.ends[doc]
    starts = np.flatnonzero(whole)
    if not len(starts):
        return starts, least[:0], starts, starts
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (at[starts][1:] != at[starts][:-1]) | (doc[starts][1:] != doc[starts][:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    return doc[starts[first]], least[starts[first]], starts[first], count


def text_hash(words: Words, doc: int) -> tuple[int, int]:
    """128 bits of a text's words, by position."""
    h = words.hashes[words.starts[doc] : words.ends[doc]]
    place = mixed(np.arange(1, len(h) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    pair = mixed(h ^ place).sum(), mixed(h + place * np.uint64(3)).sum()
    return tuple(int(np.uint64(x).view(np.int64)) for x in pair)


def surveyed(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc_id, n, h1, h2, anchors) of every text."""

    def scan(batches):
        for batch in batches:
            for block in blocks(batch):
                words = Words(texts(block))
                doc, anchor, _, _ = fragments(words, window, gram)
                cuts = np.searchsorted(doc, np.arange(len(words.lens) + 1))
                hashes = [text_hash(words, d) for d in range(len(words.lens))]
                yield pa.RecordBatch.from_arrays(
                    [
                        block.column("doc_id"),
                        pa.array(words.lens),
                        pa.array([h[0] for h in hashes], pa.int64()),
                        pa.array([h[1] for h in hashes], pa.int64()),
                        ragged([anchor[a:b].view(np.int64) for a, b in zip(cuts, cuts[1:], strict=False)]),
                    ],
                    names=["doc_id", "n", "h1", "h2", "anchors"],
                )

    return docs.mapInArrow(scan, "doc_id long, n long, h1 long, h2 long, anchors array<long>")


def _marked(block: pa.RecordBatch, words: Words, window: int, gram: int) -> Iterator[tuple]:
    """(row, anchor, start in the text, windows, heavy) of the fragments whose anchors are in the row's table."""
    doc, anchor, start, count = fragments(words, window, gram)
    anchor = anchor.view(np.int64)
    cuts = np.searchsorted(doc, np.arange(len(words.lens) + 1))
    hot = block.column("hot").to_pylist()
    for row, table in enumerate(hot):
        if not table:
            continue
        heavy = {x["anchor"]: x["heavy"] for x in table}
        own = slice(cuts[row], cuts[row + 1])
        for a, s, c in zip(anchor[own].tolist(), (start[own] - words.starts[row]).tolist(), count[own].tolist(), strict=True):
            if a in heavy:
                yield row, a, s, c, heavy[a]


def sent(met: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, heavy, doc_id, start, fragment) of met(doc_id, text, hot): what may repeat, equal ones once a block.

    A heavy anchor's fragments are cut into single windows. What has been gathered is sent when it is MOST_SENT.
    """

    def gathered(first: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in first], pa.int64()),
                pa.array([k[1] for k in first], pa.bool_()),
                pa.array([v[0] for v in first.values()], pa.int64()),
                pa.array([v[1] for v in first.values()], pa.int64()),
                pa.array([k[2] for k in first], pa.large_binary()).cast(pa.binary()),
            ],
            names=["anchor", "heavy", "doc_id", "start", "fragment"],
        )

    def scan(batches):
        for batch in batches:
            for block in blocks(batch):
                words = Words(texts(block))
                ids, first = block.column("doc_id").to_pylist(), {}
                for row, anchor, start, count, heavy in _marked(block, words, window, gram):
                    own = words.lists[row]
                    for at, n in ((start + i, 1) for i in range(count)) if heavy else ((start, count),):
                        key, where = (anchor, heavy, b" ".join(own[at : at + n + window - 1])), (ids[row], at)
                        if key not in first or where < first[key]:
                            first[key] = where
                    if len(first) >= MOST_SENT:
                        yield gathered(first)
                        first = {}
                if first:
                    yield gathered(first)

    return met.select("doc_id", "text", "hot").mapInArrow(scan, "anchor long, heavy boolean, doc_id long, start long, fragment binary")


def first_windows(shard: Iterator[tuple], window: int) -> Iterator[tuple[int, int, int]]:
    """(doc_id, start, windows) that occur first, of a shard's (doc_id, start, fragment) in order."""
    seen: dict[bytes, tuple[int, int]] = {}
    automaton, only = None, None
    for doc_id, start, fragment in shard:
        if fragment in seen:
            continue
        seen[fragment] = (doc_id, start)
        symbols = fragment.split(b" ")
        if automaton is None:
            if only is None:
                only = symbols
                yield doc_id, start, len(symbols) - window + 1
                continue
            automaton = SuffixAutomaton([only])
        new = [i - window + 1 for i, n in enumerate(automaton.matching(symbols)) if n < window <= i + 1]
        if not new:
            continue
        run = new[0]
        for i, j in zip(new, [*new[1:], None], strict=True):
            if j != i + 1:
                yield doc_id, start + run, i - run + 1
                run = j
        automaton.add(symbols)


def first_occurrences(sent_rows: DataFrame, window: int) -> DataFrame:
    """(doc_id, start, n): the runs of windows that occur first in a document, of written rows of sent().

    Reference shards of light anchors meet their automaton. The single windows of heavy ones are least at their first
    occurrence, which an aggregation finds, so no task has all occurrences of a passage, however many there are.
    """

    def rows(batches):
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc_id", "start", "fragment")), strict=True)

    def scan(batches):
        out: list[tuple[int, int, int]] = []
        names = ["doc_id", "start", "n"]
        for _, shard in groupby(rows(batches), key=lambda r: r[0]):
            out += first_windows((r[1:] for r in shard), window)
            if len(out) >= 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    light = sent_rows.where("not heavy").select("anchor", "doc_id", "start", "fragment")
    dealt = light.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "start")
    found = dealt.mapInArrow(scan, "doc_id long, start long, n long")
    least = sent_rows.where("heavy").groupBy("anchor", "fragment").agg(F.min(F.struct("doc_id", "start")).alias("first"))
    return found.union(least.select("first.doc_id", "first.start", F.lit(1).cast("long")))


def removed(docs: DataFrame, window: int, gram: int, spans: bool) -> tuple[DataFrame, Scratch]:
    """docs with its columns renamed by native.aside, and _doc_id (no null), n_words, n_removed, kept_sha256 and, if
    spans are asked for, kept_text; and the folder of the tables that this reads."""
    scratch = Scratch(docs.sparkSession, "substrings")
    renamed, own = native.aside(docs)
    unnamed = F.lit(FIRST_UNNAMED) + F.xxhash64(own["text"]).bitwiseAND(F.lit(FIRST_UNNAMED - 1))
    rows = renamed.withColumns({"doc_id": F.coalesce(own["doc_id"].cast("long"), unnamed), "text": own["text"]})
    slim = rows.select("doc_id", "text")
    table = scratch.put(surveyed(slim, window, gram), "survey").where(f"n >= {window}")
    reps = scratch.put(table.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")), "reps")
    copies = table.select("doc_id", "h1", "h2").join(reps, ["h1", "h2"]).where("doc_id > rep").groupBy("doc_id").agg(F.collect_set("h1").alias("copy_of"))
    firsts = table.join(reps.withColumnRenamed("rep", "doc_id"), ["doc_id", "h1", "h2"], "left_semi")
    placed = scratch.put(firsts.select("doc_id", F.explode("anchors").alias("anchor")), "placed")
    often = scratch.put(placed.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor", (F.col("c") > HEAVY).alias("heavy")), "often")
    hot = placed.join(often, "anchor").groupBy("doc_id").agg(F.collect_set(F.struct("anchor", "heavy")).alias("hot"))
    info = scratch.put(hot.join(copies, "doc_id", "full"), "marks")
    scratch.drop("survey", "reps", "placed", "often")

    met = rows.repartition("doc_id").join(info, "doc_id", "left")
    found = scratch.put(sent(met.where("hot is not null"), window, gram), "sent")
    kept = first_occurrences(found, window).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("kept"))
    kept = scratch.put(kept, "kept")
    scratch.drop("sent")
    carried = list(renamed.columns)
    whole = met.join(kept, "doc_id", "left").select(*carried, "doc_id", "text", "hot", "copy_of", "kept")

    def finish(batches):
        for batch in batches:
            for block in blocks(batch):
                raw = texts(block)
                words = Words(raw)
                stay = [np.ones(n, dtype=bool) for n in words.lens]
                repeats: dict[int, np.ndarray] = {}
                for row, _, start, count, _ in _marked(block, words, window, gram):
                    repeats.setdefault(row, np.zeros(words.lens[row] + 1, dtype=bool))[start : start + count] = True
                kept = block.column("kept").to_pylist()
                for row, gone in repeats.items():
                    for x in kept[row] or ():
                        gone[x["start"] : x["start"] + x["n"]] = False
                    edge = np.zeros(len(gone) + window, dtype=np.int64)
                    at = np.flatnonzero(gone)
                    edge[at] += 1
                    edge[at + window] -= 1
                    stay[row] = np.cumsum(edge)[: words.lens[row]] == 0
                for row, hashes in enumerate(block.column("copy_of").to_pylist()):
                    if hashes and words.lens[row] >= window and text_hash(words, row)[0] in hashes:
                        stay[row][:] = False
                left = [b" ".join(w if s.all() else [x for x, y in zip(w, s.tolist(), strict=True) if y]) for w, s in zip(words.lists, stay, strict=True)]
                cut = [x if not s.all() else t for x, s, t in zip(left, stay, raw, strict=True)] if spans else [None] * len(left)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(block.column(c) for c in carried if spans or c != own_text),
                        block.column("doc_id"),
                        pa.array(words.lens),
                        pa.array([int(len(s) - s.sum()) for s in stay], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in left]),
                        pa.array(cut, pa.large_binary()).cast(pa.binary()).cast(pa.string()),
                    ],
                    names=[*(c for c in carried if spans or c != own_text), "_doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
                )

    own_text = carried[docs.columns.index("text")]
    fields = [T.StructField(f.name, f.dataType) for f in renamed.schema if spans or f.name != own_text]
    more = [T.StructField(c, T.LongType()) for c in ("_doc_id", "n_words", "n_removed")] + [T.StructField(c, T.StringType()) for c in ("kept_sha256", "kept_text")]
    return whole.mapInArrow(finish, T.StructType(fields + more)), scratch


def removals(docs: DataFrame, window: int = 20, gram: int = GRAM, spans: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) of every row of docs(doc_id, text).

    A word goes if a window of `window` words that covers it occurs earlier: in a document of smaller doc_id, or further
    to the front of the same one. Null ids come last, in an order by their texts. Kept words are joined by a space. A
    null or empty text, or one shorter than the window, loses nothing; a very long one is searched whole. Rows that
    repeat a doc_id, or a null, and a text are one document and have one result; rows that repeat a doc_id with other
    texts count as the same document. An empty table has no rows; other columns are ignored. kept_text is null unless
    spans is asked for, and then a text as it was where it loses nothing.
    """
    found, scratch = removed(docs.select("doc_id", "text"), window, gram, spans)
    named = F.when(F.col("_doc_id") < FIRST_UNNAMED, F.col("_doc_id")).alias("doc_id")
    return scratch.result(found.select(named, "n_words", "n_removed", "kept_sha256", "kept_text"), "removals")


def without_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """docs with repeated spans removed from their texts; documents that lose nothing stay as they are.

    A document of which nothing is left goes. n_chars, if there, follows a text that is cut. Every row has the result of
    its own doc_id and text, as removals() has it; the columns are those of docs, whatever their names.
    """
    found, _ = removed(docs, window, GRAM, True)
    renamed, own = native.aside(docs)
    out = own | {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        changed = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
        out["n_chars"] = F.when(F.col("n_removed") > 0, changed).otherwise(own["n_chars"])
    return found.where("n_removed = 0 or kept_text != ''").select(*[column.alias(c) for c, column in out.items()])


def op1(spark, sf_dir: str) -> DataFrame:
    """What every document loses to earlier ones, in windows of 20 words."""
    return removals(load(spark, sf_dir, "documents")).drop("kept_text")
