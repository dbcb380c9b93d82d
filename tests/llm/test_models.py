"""Quality classifier and language-model scoring."""

import numpy as np

from vecspark.llm import lm_scoring, quality_classifier
from vecspark.llm.lm_scoring import EDGE, KINDS, OWN, SYMBOLS, WindowNetwork
from vecspark.llm.tokens import Words


def around_of(rng, n):
    return rng.integers(0, SYMBOLS, (n, 4)) + np.arange(4) * (SYMBOLS + 1)


def test_network_sums_to_one_and_learns():
    network, rng = WindowNetwork(counts=np.arange(SYMBOLS)), np.random.default_rng(0)
    every = np.arange(SYMBOLS)
    for row in around_of(rng, 3):
        p = np.exp(network.log_probability(np.tile(row, (SYMBOLS, 1)), every))
        assert abs(p.sum() - 1) < 1e-3
    words = rng.integers(0, SYMBOLS, 200)
    around = words[:, None] + np.arange(4) * (SYMBOLS + 1)
    before = network.log_probability(around, (words * 7) % SYMBOLS).mean()
    for _ in range(60):
        network.train(around, (words * 7) % SYMBOLS)
    assert network.log_probability(around, (words * 7) % SYMBOLS).mean() > before + 2


def test_gradients():
    rng = np.random.default_rng(1)
    around, words = around_of(rng, 50), rng.integers(0, SYMBOLS, 50)
    start = WindowNetwork(counts=np.ones(SYMBOLS)).flat
    for at in (0, 5):
        network = WindowNetwork(start)
        network.train(around, words, rate=1e-2, embedding_rate=1e-2)
        for name in ("row_bias", "rows", "columns"):
            own, moved = WindowNetwork(start.astype(np.float64)), getattr(network, name).ravel() - getattr(WindowNetwork(start), name).ravel()
            values = getattr(own, name).reshape(-1)
            base = own.log_probability(around, words).astype(np.float64).mean()
            values[at] += 0.05
            assert abs(moved[at] / 1e-2 - (own.log_probability(around, words).mean() - base) / 0.05) < 5e-3
        place = int(around[at, 0])
        moved = (network.embed[place] - WindowNetwork(start).embed[place]) / 1e-2
        own = WindowNetwork(start)
        base = own.log_probability(around, words).sum(dtype=np.float64)
        own.embed[place, 3] += 0.05
        count = (around == place).sum()
        assert abs(moved[3] * np.sqrt(count) - (own.log_probability(around, words).sum(dtype=np.float64) - base) / 0.05) < 2e-2


def plain_score(text, model, n):
    """Word by word from the formulas, in double precision. n: counts of all words by id."""
    net, own = WindowNetwork(model.flat), dict(zip(model.lexicon.words.tolist(), model.lexicon.symbols.tolist(), strict=True))
    words = text.lower().split()
    ids = lm_scoring.word_ids(Words([text], lower=True)).tolist()
    symbol = [own[i] if i in own else OWN + int(lm_scoring.kinds([w])[0]) for i, w in zip(ids, words, strict=True)]
    total = 0.0
    for at, s in enumerate(symbol):
        near = [symbol[at + d] if 0 <= at + d < len(symbol) else SYMBOLS for d in (-2, -1, 1, 2)]
        h = np.tanh(sum(net.embed[p * (SYMBOLS + 1) + x].astype(float) for p, x in enumerate(near)))
        outer, inner = h @ net.rows + net.row_bias, h @ net.columns + net.column_bias[s // EDGE]
        total += outer[s // EDGE] - np.log(np.exp(outer).sum()) + inner[s % EDGE] - np.log(np.exp(inner).sum())
        if s >= OWN:
            total += np.log(n.get(ids[at], 1)) - np.log(1 + model.lexicon.counts[s])
    return len(words), total


def test_scores_equal_plain_sums_whatever_the_layout_and_beat_single_words(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = {r.doc_id: r for r in lm_scoring.pseudo_likelihood(docs.repartition(1)).collect()}
    spread = {r.doc_id: r for r in lm_scoring.pseudo_likelihood(docs.repartition(5)).collect()}
    assert rows == spread
    model = lm_scoring.trained(docs)
    n = {r.word: r.n for r in model.vocabulary.collect()}
    for d, text in [tuple(r) for r in docs.limit(12).collect()]:
        count, total = plain_score(text.encode(), model, n)
        assert rows[d].n_words == count and abs(rows[d].log_likelihood - total) < 1e-4 * abs(total) + 1e-2
    every = np.array(list(n.values()))
    single = (every * np.log(every / (every.sum() + 1))).sum() / every.sum()
    assert sum(r.log_likelihood for r in rows.values()) / every.sum() > single + 0.1


def test_held_out_text_in_order_is_likelier_than_shuffled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en' and n_chars > 400").select("doc_id", "text")
    model = lm_scoring.trained(docs.where("doc_id % 2 = 0"))
    rng = np.random.default_rng(3)
    held = [tuple(r) for r in docs.where("doc_id % 2 = 1").limit(60).collect()]
    mixed = [(-d, " ".join(rng.permutation(t.split()))) for d, t in held]
    found = {r.doc_id: r.mean_log_probability for r in lm_scoring.scored(spark.createDataFrame(held + mixed, "doc_id long, text string"), model).collect()}
    assert np.mean([found[d] > found[-d] for d, _ in held if d]) > 0.9


def test_lm_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "a", 1), (3, "a", 1), (None, "b c " * 20_000, 1)], "doc_id long, text string, part int")
    rows = lm_scoring.pseudo_likelihood(docs).collect()
    assert sorted(r.n_words for r in rows) == [0, 0, 1, 1, 40000]
    assert {(r.log_likelihood, r.mean_log_probability) for r in rows if r.n_words == 0} == {(0.0, None)}
    assert lm_scoring.pseudo_likelihood(docs.limit(0)).count() == 0
    assert lm_scoring.pseudo_likelihood(docs.limit(2)).count() == 2


def test_lm_trains_on_every_position_once():
    for n in (0, 1, 5, 2047, 2048, 9003):
        assert sorted(i for some in lm_scoring.batches_of(n) for i in range(n)[some]) == list(range(n))
    symbol, around = lm_scoring.windows([np.array([5, 6, 7], np.uint16), np.array([], np.uint16), np.array([8], np.uint16)])
    assert symbol.tolist() == [5, 6, 7, 8]
    pad = SYMBOLS
    assert (around - np.arange(4) * (SYMBOLS + 1)).tolist() == [[pad, pad, 6, 7], [pad, 5, 7, pad], [5, 6, pad, pad], [pad, pad, pad, pad]]


def test_lm_vocabulary_counts_every_word_and_leaves_one_case_for_the_unseen(spark, sf_dir):
    from collections import Counter

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = lm_scoring.trained(docs.repartition(3))
    counts = Counter(w for r in docs.collect() for w in r.text.encode().lower().split())
    every = sorted(counts)
    ids = lm_scoring.word_ids(Words([b" ".join(every)])).tolist()
    assert {r.word: r.n for r in model.vocabulary.collect()} == {i: counts[w] for i, w in zip(ids, every, strict=True)}
    assert len(every) > SYMBOLS and model.lexicon.counts.sum() == sum(counts.values())
    own = set(model.lexicon.words.tolist())
    assert len(own) == OWN and min(counts[w] for i, w in zip(ids, every, strict=True) if i in own) >= max(counts[w] for i, w in zip(ids, every, strict=True) if i not in own)
    # the shares of a kind's words and of one unseen word sum to one
    shares = np.zeros(KINDS)
    for i, w in zip(ids, every, strict=True):
        if i not in own:
            k = int(lm_scoring.kinds([w])[0])
            shares[k] += counts[w] / (1 + model.lexicon.counts[OWN + k])
    assert np.allclose(shares + 1 / (1 + model.lexicon.counts[OWN:]), 1)
    more = spark.createDataFrame([(1, "neverseenword " * 3), (2, None)], "doc_id long, text string")
    found = {r.doc_id: r for r in lm_scoring.scored(more, model).collect()}
    assert found[1].n_words == 3 and found[1].log_likelihood < 0 and found[2].log_likelihood == 0


def test_em_recovers_accuracies():
    rng = np.random.default_rng(2)
    truth = rng.random(20_000) < 0.8
    right = np.array([0.95, 0.8, 0.7, 0.9])
    votes = np.where(rng.random((20_000, 4)) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.3] = -1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    tables, prior, _ = quality_classifier.expectation_maximisation(patterns, counts.astype(float))
    assert abs(prior - 0.8) < 0.03
    for j, r in enumerate(right):
        assert abs(tables[1, j, 2] / tables[1, j, 1:].sum() - r) < 0.06


def test_classifier_agrees_with_held_out_labels(spark):
    found = quality_classifier.op2(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = found.join(labels, "doc_id").select("kept", "quality").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) > 0.92 * len(rows)


def test_classifier_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 2), (2, "", 2), (None, "A b. " * 30_000, 2), (4, "x", 2), (4, "x", 2)], "doc_id long, text string, votes int")
    rows = quality_classifier.classify(docs).collect()
    assert len(rows) == 5 and len({r.score for r in rows if r.doc_id == 4}) == 1
    assert quality_classifier.classify(docs.limit(0)).count() == 0


def plain_votes(text):
    text = text or ""
    n, size = len(text.split()), len(text)
    lines = [x for x in (line.strip(" \t\n\x0b\x0c\r") for line in text.split("\n")) if x]
    chars = sum(map(len, lines))
    ended = sum(len(x) for x in lines if x[-1] in ".!?:;,-…。！？\"'”’»)]")
    symbols, bars, capitals, marks = (sum(text.count(c) for c in some) for some in ("#*$%&<>{}", "|", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ".!?"))
    rules = [
        (n < 10, n >= 40),
        (20 * symbols > size, 200 * symbols < size),
        (2 * ended < chars, 10 * ended >= 9 * chars),
        (40 * bars > size, False),
        (5 * capitals > size, 12 * capitals < size),
        (4 * len(set(lines)) < 3 * len(lines), len(set(lines)) == len(lines)),
        (60 * marks < n or 2 * marks > n, marks * 30 > n and 4 * marks < n),
    ]
    return [0 if bad else 1 if good else -1 for bad, good in rules]


def plain_model(texts):
    """Posterior and score of every text: EM over rows one by one, and the linear model on dictionaries."""
    import re
    import zlib
    from math import exp, log, sqrt

    votes = [plain_votes(t) for t in texts]
    labels = [(1 + v.count(1)) / (2 + v.count(1) + 3 * v.count(0)) for v in votes]
    for _ in range(100):
        prior = (sum(labels) + 1) / (len(labels) + 2)
        table = [[{v: 0.1 for v in (-1, 0, 1)} for _ in votes[0]] for _ in (0, 1)]
        for vote, q in zip(votes, labels, strict=True):
            for j, v in enumerate(vote):
                table[0][j][v] += 1 - q
                table[1][j][v] += q
        total = [[sum(x.values()) for x in of] for of in table]
        labels = []
        for vote in votes:
            logs = [log(p) + sum(log(table[c][j][v] / total[c][j]) for j, v in enumerate(vote)) for c, p in ((0, 1 - prior), (1, prior))]
            labels.append(1 / (1 + exp(min(50, max(-50, logs[0] - logs[1])))))

    def shape(word):
        kind = lambda c: 48 if 48 <= c <= 57 else 65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else c
        return re.sub(rb"(.)\1+", rb"\1", bytes(map(kind, word)), flags=re.DOTALL)

    def features(text):
        raw = (text or "").encode()
        words, lines = raw.split(), [x for x in map(bytes.strip, raw.split(b"\n")) if x]
        out: dict = {}
        for w in words:
            at = zlib.crc32(shape(w)) % 8192
            out[at] = out.get(at, 0) + 1 / len(words)
        for x in lines:
            at = 12288 + zlib.crc32(x[-1:]) % 4096
            out[at] = out.get(at, 0) + 1 / len(lines)
        out = {k: sqrt(v) for k, v in out.items()}
        for at in (8192 + min(12, len(words).bit_length()), 8192 + 20 + 10 * len(set(lines)) // max(1, len(lines))):
            out[at] = 0.3
        return out

    rows, weights, squares = [features(t) for t in texts], {}, {}
    share = min(max(sum(labels) / len(labels), 0.01), 0.99)
    dot = lambda row: sum(weights.get(k, 0.0) * v for k, v in row.items()) + weights.get("bias", 0.0)
    for _ in range(150):
        step: dict = {}
        for row, q in zip(rows, labels, strict=True):
            error = (0.5 / share if q > 0.5 else 0.5 / (1 - share)) * (q - 1 / (1 + exp(-min(30, max(-30, dot(row))))))
            for k, v in [*row.items(), ("bias", 1.0)]:
                step[k] = step.get(k, 0.0) + error * v
        for k, v in step.items():
            g = v / len(rows) - 1e-5 * weights.get(k, 0.0)
            squares[k] = squares.get(k, 1e-8) + g * g
            weights[k] = weights.get(k, 0.0) + 0.3 * g / sqrt(squares[k])
    return votes, labels, [1 / (1 + exp(-dot(row))) for row in rows]


def test_classifier_against_a_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    votes, posterior, score = plain_model([r.text for r in docs])
    found = {r.doc_id: r for r in quality_classifier.op2(spark, sf_dir).collect()}
    for r, v, q, p in zip(docs, votes, posterior, score, strict=True):
        assert found[r.doc_id].votes == v and abs(found[r.doc_id].posterior - q) < 1e-6
        assert abs(found[r.doc_id].score - p) < 1e-5 and found[r.doc_id].kept == (found[r.doc_id].score >= 0.5)


def test_classifier_without_a_sample_falls_back_on_the_labellers(spark):
    rows = [(None, "| # | # " * 40)] * 120 + [(i, "This is a plain sentence of ten words or so. " * 8) for i in range(30)]
    for sample in (0, 1, 30):
        found = quality_classifier.classify(spark.createDataFrame(rows, "doc_id long, text string"), sample=sample).collect()
        assert len(found) == 150
        if sample == 0:
            assert all(r.score == r.posterior for r in found)
            assert {r.kept for r in found if r.doc_id is None} == {False} and {r.kept for r in found if r.doc_id is not None} == {True}
