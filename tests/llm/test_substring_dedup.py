import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

import vecspark.llm.substring_dedup as dedup
from vecspark.llm.suffix_automaton import SuffixAutomaton

from . import brute


@given(st.lists(st.text("abc", max_size=12), max_size=4), st.text("abcd", max_size=20))
def test_matching_statistics(sequences, text):
    known = list(SuffixAutomaton(sequences).matching(text))
    for end, n in enumerate(known):
        lengths = [k for k in range(end + 2) if any(text[end + 1 - k : end + 1] in s for s in sequences) or k == 0]
        assert n == max(lengths)


def got(df):
    return sorted(tuple(r) for r in df.drop("kept_text").collect())


def test_fixture_matches_dictionary(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert got(dedup.op1(spark, sf_dir)) == brute.repeats(rows, 20)


@pytest.mark.parametrize("heavy", [1000, 2])
def test_shared_passages_and_periodic_texts(spark, monkeypatch, heavy):
    monkeypatch.setattr(dedup, "HEAVY", heavy)
    monkeypatch.setattr(dedup, "MOST_SENT", heavy * 3)
    rng = random.Random(heavy)
    passages = [[f"p{p}x{rng.randrange(9)}" for _ in range(rng.randrange(15, 70))] for p in range(4)]
    rows = []
    for d in range(60):
        w = []
        for _ in range(rng.randrange(0, 5)):
            w += [f"r{rng.randrange(5000)}" for _ in range(rng.randrange(0, 30))] + rng.choice(passages)[rng.randrange(5) :]
        rows.append((d, rng.choice([" ", "\n", "\t "]).join(w)))
    rows += [(60, "a b " * 100), (61, "a " * 90), (62, rows[3][1]), (63, rows[3][1].replace(" ", "  ")), (64, None), (65, ""), (66, " ".join(f"u{i}" for i in range(19)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(dedup.removals(docs)) == brute.repeats(rows, 20)


def test_nulls_repeats_long_texts_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(5, long, "x"), (5, long, "x"), (7, "z " + long, "x"), (None, long, "x"), (6, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, anchors string")
    found = sorted(((r.doc_id, r.n_words, r.n_removed) for r in dedup.removals(docs).collect()), key=str)
    assert found == sorted([(5, 60000, 0), (5, 60000, 0), (7, 60001, 60000), (None, 60000, 60000), (6, 0, 0)], key=str)
    nameless = spark.createDataFrame([(None, "q " + long[:500]), (None, "r s " + long[:500]), (None, "q " + long[:500]), (None, None)], "doc_id long, text string")
    lost = sorted((r.n_words, r.n_removed) for r in dedup.removals(nameless).collect())
    n = len(long[:500].split())
    assert lost in ([(0, 0), (n + 1, 0), (n + 1, 0), (n + 2, n)], [(0, 0), (n + 1, n), (n + 1, n), (n + 2, 0)])
    assert dedup.removals(docs.limit(0)).count() == 0


def test_stage_cuts_texts_and_keeps_columns(spark):
    p = " ".join(f"p{i}" for i in range(30))
    docs = spark.createDataFrame([(1, p + " a", "s", 9), (2, "b " + p + " c", "s", 9), (3, p, "s", 9), (4, "q\n r", "s", 4)], "doc_id long, text string, source string, n_chars long")
    assert sorted(tuple(r) for r in dedup.without_repeats(docs).collect()) == [(1, p + " a", "s", 9), (2, "b c", "s", 3), (4, "q\n r", "s", 4)]


def test_stage_rows_keep_their_own_result(spark):
    p = " ".join(f"p{i}" for i in range(30))
    schema = "doc_id long, text string, kept_text string, hot int, _doc_id int, n_chars int"
    rows = [(2, p + " a", "k", 1, 2, 9), (3, "b " + p, "l", 1, 2, 9), (3, "b " + p, "m", 1, 2, 9), (3, "no repeat", "n", 1, 2, 9), (None, p + "  c", "o", 1, 2, 9), (None, "d", "p", 1, 2, 9), (None, None, "q", 1, 2, 9), (4, p, "r", 1, 2, 9), (5, "", "s", 1, 2, 9)]
    docs = spark.createDataFrame(rows, schema)
    out = dedup.without_repeats(docs)
    assert out.dtypes == docs.dtypes
    wanted = [rows[0], (3, "b", "l", 1, 2, 1), (3, "b", "m", 1, 2, 1), rows[3], (None, "c", "o", 1, 2, 1), rows[5], rows[6], rows[8]]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, wanted))
