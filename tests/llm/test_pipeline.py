"""run() against plain versions of its stages."""

import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

from vecspark.llm import pipeline

from . import brute
from .test_native_operators import plain_mix
from .test_packing import PATH


def pairs(docs):
    return sorted((tuple(r) for r in docs.select("doc_id", "text").collect()), key=str)


def check_mixed(before, after):
    """before: [(doc_id, text, source)] of unique ids; after: [(doc_id, text)]."""
    target, blocks = plain_mix(before, 16)
    whole, size, got = {d: (t, s) for d, t, s in before}, Counter(), Counter()
    by_doc: dict = {}
    for d, t in after:
        text, source = whole[d]
        assert t == text or brute.words(t) == brute.words(text)[: len(brute.words(t))]
        by_doc.setdefault(d, []).append(t)
        got[source] += len(brute.words(t))
    for _, t, s in before:
        size[s] += len(brute.words(t))
    for d, some in by_doc.items():
        # whole copies first, and at most one cut one
        assert len(some) <= 2 and sum(t != whole[d][0] for t in some) <= 1
    for source, n in got.items():
        assert n == min(16 * blocks[source], 2 * size[source]) and abs(n - target[source]) <= 16 * len(size) + 16


def check_packed(texts, rows):
    """texts: [(doc_id, text)], where ids may repeat; rows: pieces."""
    tokenizer = Tokenizer.from_file(PATH)
    copies: dict = {}
    for d, t in texts:
        copies.setdefault(d, []).append(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4"))
    held: dict = {}
    sizes: dict = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sizes.get(r.sequence_id, 0)
        sizes[r.sequence_id] = r.offset + r.length
        held.setdefault(r.doc_id, []).append(r)
    assert all(n <= 2048 and n & (n - 1) == 0 for n in sizes.values())
    assert held.keys() == copies.keys()
    for d, some in held.items():
        assert sum(r.length for r in some) == sum(map(len, copies[d]))
        assert Counter(r.doc_tokens for r in some if r.start == 0) == Counter(map(len, copies[d]))
        assert all(any(len(ids) == r.doc_tokens and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for ids in copies[d]) for r in some)


def test_stages_against_plain_versions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        before = pairs(docs)
        rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns
        assert all(r.n_chars == len(r.text) for r in docs.collect())
        after = pairs(docs)
        if name == "quality_rules":
            found = {d: brute.rules(t) for d, t in before}
            assert after == sorted(((d, f[-1]) for d, f in found.items() if f[-2]), key=str)
        if name == "ngram_jaccard_join":
            first = {d for d, _, c in brute.jaccard_groups(before, 5, 80) if d == c}
            assert after == sorted((r for r in before if r[0] in first), key=str)
        if name == "substring_dedup":
            wanted = {d: (n, gone) for d, n, gone, _ in brute.repeats(before, 40)}
            left = {d: len(brute.words(t)) for d, t in after}
            assert all(left.get(d, 0) == n - gone for d, (n, gone) in wanted.items())
            assert all(t == dict(before)[d] for d, t in after if wanted[d][1] == 0)
        if name == "mixing":
            check_mixed(rows, after)
    pieces = pipeline.run(spark, sf_dir).collect()
    check_packed(after, pieces)


def test_odd_rows_through_run(spark, tmp_path):
    line = lambda i, n: " ".join(f"w{i}x{j} v{i}x{j} u{i}x{j}" for j in range(n)) + "."
    text = lambda i: "\n".join(line(f"{i}y{k}", 6) for k in range(8))
    rows = [(1, text(1), "a"), (1, text(1), "a"), (1, text(2), "a"), (None, text(3), None), (None, text(3), None), (None, text(4), "b"), (2, None, "a"), (3, "", "b"), (4, text(5), None)]
    rows += [(5, "\n".join(line(f"z{k}", 6) for k in range(3000)), "b"), (6, text(5) + " More words.", "c")]
    docs = spark.createDataFrame([(*r, 0, "x", 1, "kept", 5) for r in rows], "doc_id long, text string, source string, n_chars long, lang string, size int, kept string, taken int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = pipeline.run(spark, str(tmp_path)).collect()
    # repeated rows stay as they came up to the mix, null ids as well; 6 is a near copy of 4
    assert {r.doc_id for r in found} <= {1, None, 4, 5} and {1, None, 5} <= {r.doc_id for r in found}
    stages, now = dict(pipeline.STAGES), docs
    kept = stages["quality_rules"](spark, now, "")
    assert kept.dtypes == docs.dtypes and kept.count() == 9
    unique = stages["ngram_jaccard_join"](spark, kept, "")
    assert sorted(str(r.doc_id) for r in unique.collect()) == ["1", "1", "1", "4", "5", "None", "None", "None"]
    cut = stages["substring_dedup"](spark, unique, "")
    assert cut.dtypes == docs.dtypes and sorted(map(str, cut.collect())) == sorted(map(str, unique.collect()))
    mixed = stages["mixing"](spark, cut, "")
    assert mixed.dtypes == docs.dtypes
    size = sum(len(brute.words(r.text)) for r in cut.collect())
    assert size < sum(len(brute.words(r.text)) for r in mixed.collect()) <= 1.5 * size


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
