"""Masked pseudo-likelihood of documents under a bidirectional window network, trained here in numpy.

Words. A scan counts every word of every document into a vocabulary, a written table that grows with the corpus. The
`OWN` most frequent words are symbols of their own; any other is one of `KINDS` symbols, by its last two bytes.

Network. It predicts a word from the `SIDE` words before and after it. The embeddings of the neighbours' symbols, one
table for each place, are summed and pass a tanh; two softmaxes give the row and the column of the symbol in a square of
`EDGE` x `EDGE`, that of the column with a bias for each row. A word that shares its symbol then has its share in the
symbol by its count in the vocabulary, beside one more count for all unseen words. So probabilities sum to one over the
vocabulary and one unseen word, and the biases start as the unigram model.

Training masks every position of every document once. Documents are dealt by a hash of themselves into rounds, and
within a round into groups of about `GROUP_TOKENS`; each group starts from the mean of the round before, and the mean of
its groups, weighed by tokens, ends a round. Groups and their order come from the rows and not from how they are
stored, so the scores don't depend on the number of tasks. The parameters, about 1 MB at every size, are collected as
means of chunks and broadcast.

Scoring. The scan that turns words into symbols also gathers the other words of about `PART_BYTES` of text, whose counts
are joined, and each part of the documents meets its own words. Every word of every document is predicted from both
sides.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm.shared import Scratch, load, written
from vecspark.llm.tokens import Words, blocks, mixed, texts

#: Symbols are EDGE * EDGE: the most frequent words and the kinds of others.
EDGE, OWN, KINDS, HIDDEN, SIDE = 64, 3072, 1024, 16, 2
SYMBOLS, PLACES = EDGE * EDGE, 2 * SIDE
BATCH, RATE, EMBEDDING_RATE, CHUNKS, SEED = 2048, 1.0, 0.2, 32, 11
#: Ends of the rounds in 32nds of the documents: a short first one, so that no later group starts from nothing.
ROUNDS, GROUP_TOKENS, SPLIT_TOKENS = (1, 8, 32), 1 << 20, 1 << 17
#: Bytes of text whose words are looked up together, and of a block that is counted at once.
PART_BYTES = 8 << 20


class Lexicon(NamedTuple):
    """The most frequent words, by hash, their symbols, and the count of each symbol over all documents."""

    words: np.ndarray
    symbols: np.ndarray
    counts: np.ndarray


class Trained(NamedTuple):
    """Parameters, the lexicon, and vocabulary(word, n, kind)."""

    flat: np.ndarray
    lexicon: Lexicon
    vocabulary: DataFrame


class WindowNetwork:
    """embed: (places x symbols and padding, hidden); rows, columns: weights; row_bias; column_bias: by row."""

    def __init__(self, flat: np.ndarray | None = None, counts: np.ndarray | None = None):
        shapes = ((PLACES * (SYMBOLS + 1), HIDDEN), (HIDDEN, EDGE), (HIDDEN, EDGE), (EDGE,), (EDGE, EDGE))
        sizes = [int(np.prod(s)) for s in shapes]
        if flat is None:
            rng = np.random.default_rng(SEED)
            share = (np.zeros(SYMBOLS) if counts is None else counts) + 1.0
            square = (share / share.sum()).reshape(EDGE, EDGE)
            by_row = square.sum(axis=1)
            flat = np.concatenate([rng.normal(0, 0.1, sum(sizes[:3])), np.log(by_row), np.log(square / by_row[:, None]).ravel()])
        self.flat = np.array(flat, dtype=np.float32)
        self.embed, self.rows, self.columns, self.row_bias, self.column_bias = (
            x.reshape(s) for x, s in zip(np.split(self.flat, np.cumsum(sizes)[:-1]), shapes, strict=True)
        )

    def _forward(self, around: np.ndarray, symbol: np.ndarray) -> tuple:
        """Hidden layer, row and column of the symbol, exponentials of both layers and their sums, log-probability."""
        total = self.embed[around[:, 0]]
        for place in range(1, PLACES):
            total += self.embed[around[:, place]]
        h, row, column, at = np.tanh(total), symbol // EDGE, symbol % EDGE, np.arange(len(symbol))
        outer, inner = h @ self.rows, h @ self.columns
        outer += self.row_bias
        inner += self.column_bias[row]
        np.clip(outer, -80, 60, out=outer)
        np.clip(inner, -80, 60, out=inner)
        log = outer[at, row] + inner[at, column]
        np.exp(outer, out=outer)
        np.exp(inner, out=inner)
        sums = outer.sum(axis=1), inner.sum(axis=1)
        return h, row, column, outer, inner, sums, log - np.log(sums[0]) - np.log(sums[1])

    def log_probability(self, around: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probabilities of symbols between their neighbours (rows of embed)."""
        return self._forward(around, symbol)[-1]

    def train(self, around: np.ndarray, symbol: np.ndarray, rate: float = RATE, embedding_rate: float = EMBEDDING_RATE) -> None:
        """One step of gradient ascent. Sums over a row or an embedding's few positions count by their root."""
        h, row, column, outer, inner, sums, _ = self._forward(around, symbol)
        n, at = len(symbol), np.arange(len(symbol))
        outer *= (-1 / sums[0])[:, None]
        inner *= (-1 / sums[1])[:, None]
        outer[at, row] += 1
        inner[at, column] += 1
        back = outer @ self.rows.T
        back += inner @ self.columns.T
        back *= 1 - h * h
        self.rows += (rate / n) * (h.T @ outer)
        self.columns += (rate / n) * (h.T @ inner)
        self.row_bias += (rate / n) * outer.sum(axis=0)
        which, order, first, count = _runs(row.astype(np.uint16))
        self.column_bias[which] += (rate / np.sqrt(count * n)).astype(np.float32)[:, None] * np.add.reduceat(inner[order], first)
        which, order, first, count = _runs(around.T.ravel().astype(np.uint16))
        self.embed[which] += (embedding_rate / np.sqrt(count)).astype(np.float32)[:, None] * np.add.reduceat(back[order % n], first)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, the order that sorts all, where each begins in it, and how often it occurs."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    return ordered[first], order, first, np.diff(np.append(first, len(values)))


def word_ids(words: Words) -> np.ndarray:
    return (mixed(words.hashes) >> np.uint64(1)).astype(np.int64)


def kinds(words: list[bytes]) -> np.ndarray:
    ends = np.empty(len(words), dtype=object)
    ends[:] = [w[-2:] for w in words]
    return (pd.util.hash_array(ends, categorize=False) % np.uint64(KINDS)).astype(np.int64) if words else np.zeros(0, np.int64)


class Coded(NamedTuple):
    """A block's words as codes in order of appearance: the code of every word, and of every code its id, symbol, and
    place in rare (the ids of words without a symbol of their own), or -1."""

    codes: np.ndarray
    symbols: np.ndarray
    places: np.ndarray
    rare: np.ndarray


def distinct(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code of every word, the id of every code, and its kind."""
    codes, ids = pd.factorize(word_ids(words))
    first = np.flatnonzero(np.diff(np.maximum.accumulate(codes), prepend=-1))
    every = list(chain.from_iterable(words.lists))
    return codes, ids, kinds([every[i] for i in first.tolist()])


def coded(words: Words, lexicon: Lexicon) -> Coded:
    codes, ids, kind = distinct(words)
    symbol = (OWN + kind).astype(np.uint16)
    own = np.zeros(len(ids), dtype=bool)
    if len(lexicon.words) and len(ids):
        at = np.minimum(np.searchsorted(lexicon.words, ids), len(lexicon.words) - 1)
        own = lexicon.words[at] == ids
        symbol[own] = lexicon.symbols[at[own]]
    return Coded(codes, symbol, np.where(own, -1, np.cumsum(~own) - 1).astype(np.int32), ids[~own])


def windows(documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of some documents, end to end, and the rows of embed of those around each; padding beyond the ends."""
    gap, parts = np.full(SIDE, SYMBOLS, dtype=np.uint16), []
    for some in documents:
        parts += [gap, some]
    line = np.concatenate([*parts, gap]).astype(np.int64)
    at = np.flatnonzero(line != SYMBOLS)
    steps = np.array([*range(-SIDE, 0), *range(1, SIDE + 1)])
    return line[at], line[at[:, None] + steps] + np.arange(PLACES) * (SYMBOLS + 1)


def batches_of(n: int) -> Iterator[slice]:
    """All positions of a block, each in one batch; those of a batch stand far apart."""
    step = max(1, n // BATCH)
    for first in range(min(step, n)):
        yield slice(first, None, step)


def counted(docs: DataFrame) -> DataFrame:
    """(word, n, kind) of every word of docs(text)."""

    def scan(batches):
        for batch in batches:
            for block in blocks(batch, limit=PART_BYTES):
                codes, word, kind = distinct(Words(texts(block), lower=True))
                n = np.bincount(codes, minlength=len(word)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(n), pa.array(kind)], names=["word", "n", "kind"])

    found = docs.select("text").mapInArrow(scan, "word long, n long, kind long")
    return found.groupBy("word").agg(F.sum("n").cast("long").alias("n"), F.min("kind").alias("kind"))


def lexicon_of(vocabulary: DataFrame) -> Lexicon:
    """Collects OWN words and the totals of KINDS. A histogram of counts by bits says which words may be among them."""
    level, least, total = F.floor(F.log2("n") * 8), None, 0
    for value, n in sorted(((r["level"], r["n"]) for r in vocabulary.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True):
        least, total = value, total + n
        if total >= OWN:
            break
    top = vocabulary.where(level >= least).orderBy(F.desc("n"), "word").limit(OWN).collect() if least is not None else []
    counts = np.zeros(SYMBOLS, dtype=np.int64)
    for kind, n in vocabulary.groupBy("kind").agg(F.sum("n")).collect():
        counts[OWN + kind] = n
    for symbol, row in enumerate(top):
        counts[symbol] = row.n
        counts[OWN + row.kind] -= row.n
    words = np.array([r.word for r in top], dtype=np.int64)
    order = np.argsort(words)
    return Lexicon(words[order], order.astype(np.uint16), counts)


def encoded(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(part, doc_id, n_words, symbols, rare, words): a row for each document, with its symbols and the places of its
    rare words among those of the part as binary; and, last of a part, a row that has the part's rare words in words."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["part", "doc_id", "n_words", "symbols", "rare", "words"]

    def scan(batches):
        part = TaskContext.get().partitionId() << 32
        for batch in batches:
            for block in blocks(batch, limit=PART_BYTES):
                words = Words(texts(block), lower=True)
                found = coded(words, shared.value)
                symbol, place = found.symbols[found.codes], found.places[found.codes]
                spans, rows = list(zip(words.starts.tolist(), words.ends.tolist(), strict=True)), len(words.lens)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(rows, part)),
                        block.column("doc_id"),
                        pa.array(words.lens),
                        pa.array([symbol[a:b].tobytes() for a, b in spans], pa.binary()),
                        pa.array([(x := place[a:b])[x >= 0].tobytes() for a, b in spans], pa.binary()),
                        pa.nulls(rows, pa.list_(pa.int64())),
                    ],
                    names=names,
                )
                types = (pa.int64(), batch.schema.field("doc_id").type, pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
                columns = [[part], [None], [None], [None], [None], [found.rare]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
                part += 1

    return docs.select("doc_id", "text").mapInArrow(scan, f"part long, doc_id {kind}, n_words long, symbols binary, rare binary, words array<long>")


def learned(table: DataFrame, lexicon: Lexicon, scratch: Scratch) -> np.ndarray:
    """The parameters after all rounds over an encoded table."""
    total = table.agg(F.sum("n_words")).first()[0] or 0
    flat = WindowNetwork(counts=lexicon.counts).flat
    key = F.xxhash64("doc_id", "symbols")
    every = table.where("n_words > 0").select(key.alias("key"), "symbols")
    names = ["group", "chunk", "seen", "part"]
    before = 0
    for round_, upto in enumerate(ROUNDS):
        share = F.pmod("key", F.lit(ROUNDS[-1]))
        groups = max(1, -(-total * (upto - before) // (ROUNDS[-1] * GROUP_TOKENS)))
        start = table.sparkSession.sparkContext.broadcast(flat)

        def learn(batches, start=start):
            group, network, held, size, seen = None, None, [], 0, 0

            def step():
                symbol, around = windows(held)
                for some in batches_of(len(symbol)):
                    network.train(around[some], symbol[some])

            def sent():
                if held:
                    step()
                parts = [p.tobytes() for p in np.array_split(network.flat, CHUNKS)]
                columns = [[group] * CHUNKS, list(range(CHUNKS)), [seen] * CHUNKS, parts]
                return pa.RecordBatch.from_pydict(dict(zip(names, columns, strict=True)), schema=sending)

            for batch in batches:
                for of, raw in zip(batch.column("group").to_pylist(), batch.column("symbols").to_pylist(), strict=True):
                    if of != group:
                        if group is not None:
                            yield sent()
                        group, network, held, size, seen = of, WindowNetwork(start.value), [], 0, 0
                    held.append(np.frombuffer(raw, np.uint16))
                    size, seen = size + len(held[-1]), seen + len(held[-1])
                    if size >= SPLIT_TOKENS:
                        step()
                        held, size = [], 0
            if group is not None:
                yield sent()

        sending = pa.schema([("group", pa.int64()), ("chunk", pa.int32()), ("seen", pa.int64()), ("part", pa.binary())])
        rows = every.where((share >= before) & (share < upto)).withColumn("group", F.pmod(F.shiftrightunsigned("key", 16), F.lit(groups)))
        dealt = rows.repartition(groups, "group").sortWithinPartitions("group", "key", "symbols")
        sent = scratch.put(dealt.select("group", "symbols").mapInArrow(learn, "group long, chunk int, seen long, part binary"), f"round{round_}")
        by_chunk = sent.repartition("chunk").sortWithinPartitions("chunk", "group").select("chunk", "seen", "part")
        parts = sorted(by_chunk.mapInArrow(averaged, "chunk int, part binary").collect())
        if parts:
            flat = np.concatenate([np.frombuffer(r.part, np.float32) for r in parts])
        scratch.drop(f"round{round_}")
        start.unpersist()
        before = upto
    return flat


def averaged(batches):
    """(chunk, part): the mean of each chunk's parts, weighed by what each has seen."""
    sums: dict[int, list] = {}
    for batch in batches:
        for chunk, seen, part in zip(*(batch.column(c).to_pylist() for c in ("chunk", "seen", "part")), strict=True):
            held = sums.setdefault(chunk, [0, 0.0])
            held[0] += seen
            held[1] = held[1] + seen * np.frombuffer(part, np.float32).astype(np.float64)
    if sums:
        yield pa.RecordBatch.from_pydict(
            {"chunk": list(sums), "part": [(s / n).astype(np.float32).tobytes() for n, s in sums.values()]},
            schema=pa.schema([("chunk", pa.int32()), ("part", pa.binary())]),
        )


def _trained(docs: DataFrame) -> tuple[Trained, DataFrame]:
    scratch = Scratch(docs.sparkSession, "lm")
    vocabulary = written(counted(docs), "vocabulary")
    lexicon = lexicon_of(vocabulary)
    table = written(encoded(docs, lexicon), "encoded")
    return Trained(learned(table, lexicon, scratch), lexicon, vocabulary), table


def trained(docs: DataFrame) -> Trained:
    """The model of docs(doc_id, text); without words, uniform over symbols."""
    return _trained(docs)[0]


def scores(table: DataFrame, model: Trained) -> DataFrame:
    """The scores of an encoded table. Words that the vocabulary lacks count as the one unseen word of their symbol.

    The network's part, and that of the symbols' counts, is made where the rows are; only the places of rare words move.
    """
    small = table.sparkSession.sparkContext.broadcast((model.flat, model.lexicon.counts))
    kind = table.schema["doc_id"].dataType.simpleString()

    def predict(batches):
        flat, counts = small.value
        network, whole = WindowNetwork(flat), np.log1p(counts)
        whole[:OWN] = 0
        for batch in batches:
            symbol = [np.frombuffer(x, np.uint16) for x in batch.column("symbols").to_pylist()]
            logs, shares = [], []
            for at in range(0, len(symbol), 64):
                some = symbol[at : at + 64]
                line, around = windows(some)
                each = np.zeros(len(line) + 1)
                for a in range(0, len(line), BATCH):
                    each[a : a + len(line[a : a + BATCH])] = network.log_probability(around[a : a + BATCH], line[a : a + BATCH])
                ends = np.cumsum([len(x) for x in some]).tolist()
                logs += [float(each[b - len(x) : b].sum()) for x, b in zip(some, ends, strict=True)]
                shares += [-float(whole[x].sum()) for x in some]
            columns = [*(batch.column(c) for c in ("part", "doc_id", "n_words", "rare")), pa.array(logs, pa.float64()), pa.array(shares, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "n_words", "rare", "log", "share"])

    def look_up(rows: pa.Table, known: pa.Table) -> pa.Table:
        place, n = known["place"].to_numpy(), known["n"].to_numpy()
        count = np.ones(place.max() + 1 if len(place) else 0)
        count[place] = n
        logs = np.log(np.append(count, 1))
        share = []
        for start, raw in zip(rows["share"].to_pylist(), rows["rare"].to_pylist(), strict=True):
            at = np.frombuffer(raw, np.int32)
            share.append(start + float(logs[np.minimum(at, len(count))].sum()))
        lens = rows["n_words"].to_pylist()
        total = [x + y for x, y in zip(rows["log"].to_pylist(), share, strict=True)]
        mean = [t / n if n else None for t, n in zip(total, lens, strict=True)]
        perplexity = [None if m is None else float(np.exp(-m)) for m in mean]
        columns = [pa.array(x, pa.float64()) for x in (total, share, mean, perplexity)]
        return pa.table([rows["doc_id"], rows["n_words"], *columns], names=["doc_id", "n_words", "log_likelihood", "log_share", "mean_log_probability", "perplexity"])

    words = table.where("words is not null").select(F.col("part").alias("in_part"), F.posexplode("words").alias("place", "word"))
    known = words.join(model.vocabulary.select("word", "n"), "word").select("in_part", "place", "n")
    rows = table.where("words is null").select("part", "doc_id", "n_words", "symbols", "rare")
    predicted = rows.mapInArrow(predict, f"part long, doc_id {kind}, n_words long, rare binary, log double, share double")
    return predicted.groupBy("part").cogroup(known.groupBy("in_part")).applyInArrow(
        look_up, f"doc_id {kind}, n_words long, log_likelihood double, log_share double, mean_log_probability double, perplexity double"
    )


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, log_likelihood, log_share, mean_log_probability, perplexity) of every row of docs(doc_id, text).

    log_likelihood sums over all words of a text, however long; log_share is the part of it that shares of words in
    their symbols make. A text that is null or has no words has 0 for both and a null mean and perplexity. Equal texts
    have equal scores; repeated rows and null ids are rows of their own. An empty table has none. A-Z are lower-cased.
    Other columns are ignored.
    """
    model, table = _trained(docs)
    return scores(table, model)


def scored(docs: DataFrame, model: Trained) -> DataFrame:
    """pseudo_likelihood of docs under a model, perhaps of another corpus."""
    return scores(written(encoded(docs, model.lexicon), "encoded"), model)


def op7(spark, sf_dir: str) -> DataFrame:
    """Pseudo-likelihood of every document."""
    return pseudo_likelihood(load(spark, sf_dir, "documents"))
