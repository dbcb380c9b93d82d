"""Quality classifier without labels: heuristics vote, expectation-maximisation weighs them, a linear model learns.

1. Labellers vote good (1), bad (0) or nothing (-1) on a text.
2. The accuracies of the labellers are those of a Dawid-Skene model, fitted by expectation-maximisation to the
   counts of vote patterns over all documents. There are at most 3 ** labellers patterns, and only they are collected.
3. The posterior of its pattern labels each document. A logistic model on hashed word shapes is trained on a sample
   of at most `SAMPLE` labelled documents, and scores all of them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm import native
from vecspark.llm.quality_rules import CAPITALS, SENTENCE_ENDS
from vecspark.llm.shared import load
from vecspark.llm.tokens import blocks, texts

#: The documents that the linear model is trained on at most, and hashed features.
SAMPLE, FEATURES = 4000, 1 << 14
EPOCHS, RATE, KEEP_FROM, LABELLERS = 30, 1.0, 0.5, 7
SHAPES = bytes(48 if 48 <= i <= 57 else 65 if 65 <= i <= 90 else 97 if 97 <= i <= 122 or i >= 128 else i for i in range(256))
RUN = re.compile(rb"(.)\1+", re.DOTALL)


def held(raw: bytes, characters: bytes) -> int:
    """How many of these characters a text holds."""
    return len(raw) - len(raw.translate(None, characters))


def votes_of(raw: bytes, n: int) -> list[int]:
    """The votes of all labellers on a text of n words: good (1), bad (0), nothing (-1)."""
    text = raw.decode()
    size, lines = len(text), [x for x in (line.strip(native.SPACE) for line in text.split("\n")) if x]
    chars, ended, distinct = sum(map(len, lines)), sum(len(x) for x in lines if x[-1] in SENTENCE_ENDS), len(set(lines))
    symbols, bars, capitals, marks = held(raw, b"#*$%&<>{}"), raw.count(b"|"), held(raw, CAPITALS.encode()), held(raw, b".!?")
    said = (
        (n < 10, n >= 40),
        (20 * symbols > size, 200 * symbols < size),
        (2 * ended < chars, 10 * ended >= 9 * chars),
        (40 * bars > size, False),
        (5 * capitals > size, 12 * capitals < size),
        (4 * distinct < 3 * len(lines), distinct == len(lines)),
        (60 * marks < n or 2 * marks > n, marks * 30 > n and 4 * marks < n),
    )
    return [0 if bad else 1 if good else -1 for bad, good in said]


def counted_votes(docs: DataFrame) -> list[tuple[list[int], int]]:
    """The patterns of votes over docs(text) and how often each occurs; there are at most 3 ** LABELLERS."""

    def scan(batches):
        for batch in batches:
            found = Counter(tuple(votes_of(raw or b"", len(raw.split()) if raw else 0)) for block in blocks(batch) for raw in texts(block))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.list_(pa.int32())), pa.array(list(found.values()), pa.int64())], names=["votes", "n"])

    rows = docs.select("text").mapInArrow(scan, "votes array<int>, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()
    return sorted((list(r.votes), r.n) for r in rows)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float, np.ndarray]:
    """(tables, prior, posterior) of a two-class model: tables[class, labeller, vote + 1].

    Starts from labellers that are right more often than not, which fixes which class is good.
    """
    if not len(counts):
        return np.full((2, patterns.shape[1], 3), 1 / 3), 0.5, np.zeros(0)
    good, bad = (patterns == 1).sum(axis=1), (patterns == 0).sum(axis=1)
    posterior = (1 + good) / (2 + good + 3 * bad)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - posterior), counts * posterior])
        prior = (weight[1].sum() + 1) / (counts.sum() + 2)
        tables = np.stack([[[(weight[c] * (patterns[:, j] == v)).sum() + 0.1 for v in (-1, 0, 1)] for j in range(patterns.shape[1])] for c in (0, 1)])
        tables /= tables.sum(axis=2, keepdims=True)
        logs = [np.log(p) + sum(np.log(tables[c, j, patterns[:, j] + 1]) for j in range(patterns.shape[1])) for c, p in ((0, 1 - prior), (1, prior))]
        posterior = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
    return tables, float(prior), posterior


class Shapes(dict):
    """Hashed features of a text: the shapes of its words, as aA0 and marks with runs joined, and of line ends.

    It remembers the features of words it has seen.
    """

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        at = self[word] = zlib.crc32(RUN.sub(rb"\1", word.translate(SHAPES))) % (FEATURES // 2)
        return at

    def of(self, raw: bytes, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found, counts = np.unique(np.fromiter(map(self.__getitem__, words), np.int64, len(words)), return_counts=True)
        lines = [x for x in map(bytes.strip, raw.split(b"\n")) if x]
        ends = Counter(x[-1:] for x in lines)
        ended: dict[int, int] = {}
        for mark, n in ends.items():
            at = FEATURES // 2 + FEATURES // 4 + zlib.crc32(mark) % (FEATURES // 4)
            ended[at] = ended.get(at, 0) + n
        extra = [FEATURES // 2 + min(12, len(words).bit_length()), FEATURES // 2 + 20 + (10 * len(set(lines))) // max(1, len(lines))]
        at = np.concatenate([found, np.array([*ended, *extra], dtype=np.int64)])
        values = np.sqrt(np.concatenate([counts / max(1, len(words)), np.array([n / len(lines) for n in ended.values()]), [0.09, 0.09]]))
        return at, values


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
    """Weights and, at the end, the bias of a logistic model on soft labels, by full-batch gradient steps (Adagrad)."""
    weights = np.zeros(FEATURES + 1)
    if not rows:
        return weights
    at, values = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    row, label = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows]), np.array([r[2] for r in rows])
    # both classes count alike
    share = min(max(label.mean(), 0.01), 0.99)
    weight = np.where(label > 0.5, 0.5 / share, 0.5 / (1 - share))
    squares = np.full(FEATURES + 1, 1e-8)
    for _ in range(EPOCHS * 5):
        z = np.bincount(row, weights[at] * values, len(rows)) + weights[-1]
        error = weight * (label - 1 / (1 + np.exp(-np.clip(z, -30, 30))))
        step = np.append(np.bincount(at, error[row] * values, FEATURES), error.sum()) / len(rows) - 1e-5 * weights
        squares += step * step
        weights += RATE * 0.3 * step / np.sqrt(squares)
    return weights


def classify(docs: DataFrame, sample: int = SAMPLE, keep_from: float = KEEP_FROM) -> DataFrame:
    """(doc_id, votes, posterior, score, kept) of every row of docs(doc_id, text).

    posterior: probability of good by the labellers; score: by the linear model, or the posterior itself where the
    sample that should train it is empty; kept: score >= keep_from, so a score of just keep_from is kept. The sample is
    that of the smallest hashes of doc_id and text, at most `sample` rows. A null text counts as empty, a very long one
    is read whole. Equal texts have equal results, and repeated rows are rows of their own; a null doc_id is kept as it
    is. An empty table has no rows; other columns, also those named as results, are ignored.
    """
    docs = docs.select("doc_id", F.col("text"))
    counted = counted_votes(docs)
    patterns = np.array([votes for votes, _ in counted], dtype=np.int64).reshape(len(counted), LABELLERS)
    counts = np.array([n for _, n in counted], dtype=float)
    _, _, posterior = expectation_maximisation(patterns, counts)
    table = {tuple(p): float(q) for p, q in zip(patterns.tolist(), posterior, strict=True)}

    key, one_of = F.xxhash64("doc_id", "text"), max(1, int(counts.sum()) // max(1, sample))
    some = docs.where(F.pmod(key, F.lit(one_of)) == 0).orderBy(key).limit(sample)

    def read(shapes, raw):
        """The votes on a text and its features."""
        raw = raw or b""
        words = raw.split()
        return votes_of(raw, len(words)), *shapes.of(raw, words)

    def features(batches):
        shapes = Shapes()
        for batch in batches:
            for block in blocks(batch):
                found = [read(shapes, t) for t in texts(block)]
                kinds = (pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=["votes", "at", "value"])

    taught = some.select("text").mapInArrow(features, "votes array<int>, at array<long>, value array<double>").toPandas()
    rows = [(np.asarray(a), np.asarray(v), table[tuple(p)]) for a, v, p in zip(taught["at"], taught["value"], taught["votes"], strict=True)]
    shared = docs.sparkSession.sparkContext.broadcast((fit(rows) if rows else None, table))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches):
        weights, by_pattern = shared.value
        shapes = Shapes()
        for batch in batches:
            for block in blocks(batch):
                found = [read(shapes, t) for t in texts(block)]
                votes = pa.array([f[0] for f in found], pa.list_(pa.int32()))
                likely = np.array([by_pattern[tuple(f[0])] for f in found])
                p = likely
                if weights is not None:
                    z = np.array([weights[at] @ value for _, at, value in found]) + weights[-1]
                    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [block.column("doc_id"), votes, pa.array(likely), pa.array(p), pa.array(p >= keep_from)],
                    names=["doc_id", "votes", "posterior", "score", "kept"],
                )

    return docs.mapInArrow(score, f"doc_id {kind}, votes array<int>, posterior double, score double, kept boolean")


def op2(spark, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return classify(load(spark, sf_dir, "documents"))
