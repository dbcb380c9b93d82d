import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from vecspark.llm.packing import Encoder, Packer, op8, pack

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(df, texts):
    """texts: [(doc_id, text)]. Every id in one piece, sequences gapless, no padding."""
    tokenizer = Tokenizer.from_file(PATH)
    wanted = sorted((d, *np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4").tolist()) for d, t in texts)
    rows = [r.asDict() for r in df.collect()]
    by_id: dict = {}
    for d, *ids in wanted:
        by_id.setdefault(d, np.array(ids, dtype="<u4"))
    at: dict = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        ids = by_id[r["doc_id"]]
        assert r["start"] == at.get(r["doc_id"], 0) and r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        at[r["doc_id"]] = r["start"] + r["length"]
    assert at == {d: len(ids) for d, ids in by_id.items()}
    sizes: dict = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == sizes.get(r["sequence_id"], 0)
        sizes[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n <= 2048 and n & (n - 1) == 0 for n in sizes.values())


def test_fixture_round_trip(spark, sf_dir):
    check(op8(spark, sf_dir), [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()])


def test_null_empty_and_long_texts(spark):
    texts = [(1, None), (2, ""), (3, "a b"), (4, "word " * 30_000), (5, " \n")]
    check(pack(spark.createDataFrame([(d, t, 1) for d, t in texts], "doc_id long, text string, start int")), texts)
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert pack(spark.createDataFrame([(None, "x"), (None, "x")], "doc_id long, text string")).count() >= 2


def test_words_encode_by_themselves():
    rng, encoder = random.Random(3), Encoder(PATH)
    letters = "aAbZé ßİΣσ́  'stm.,;!?\"»«0९٣\n\t#<|endoftext|>中文한ｱ\U0001f600"
    odd = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(1500)]
    for text in [*odd, "don't. we'll, it's!! İ'S", "<|startoftext|> x<|endoftext|>y", "A<|ENDOFTEXT|>."]:
        assert encoder.ids([text.encode()])[0].tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 1]


def test_packer_keeps_every_token():
    rng, packer, lengths, out = random.Random(1), Packer(), [], []
    for doc in range(3000):
        lengths.append(rng.choice([1, 3, 200, 256, 257, 900, 1024, 2047, 2048, 2049, 5000]))
        out += packer.add(doc, lengths[-1])
        if doc % 500 == 0:
            out += packer.drain()
    out += packer.finish()
    covered = [set() for _ in lengths]
    for window, pieces in out:
        assert sum(n for _, _, n in pieces) == window
        for doc, start, n in pieces:
            assert not covered[doc] & set(range(start, start + n))
            covered[doc].update(range(start, start + n))
    assert [len(c) for c in covered] == lengths


def test_step_groups_are_full_across_tasks(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(7)
    windows: dict = {}
    for r in pack(docs).select("step_id", "window", "sequence_id").distinct().collect():
        windows.setdefault(r.window, {}).setdefault(r.step_id, set()).add(r.sequence_id)
    for window, groups in windows.items():
        sizes = sorted(map(len, groups.values()), reverse=True)
        full = max(1, 16 * 2048 // window)
        assert all(n == full for n in sizes[:-1]) and 1 <= sizes[-1] <= full
    assert len(windows[2048]) > 1 and len({s for groups in windows.values() for s in groups}) == sum(map(len, windows.values()))


def test_a_full_memory_changes_nothing(monkeypatch):
    import vecspark.llm.packing as packing

    rng = random.Random(6)
    blocks = [[" ".join(f"{rng.choice('aeiou')}w{rng.randrange(400)}É{rng.choice(['', '.', 'x'])}" for _ in range(60)).encode() for _ in range(3)] for _ in range(12)]
    wanted = [[x.tolist() for x in Encoder(PATH).ids(block)] for block in blocks]
    for most in (0, 300, 900):
        monkeypatch.setattr(packing, "CACHED_WORDS", most)
        encoder = Encoder(PATH)
        assert [[x.tolist() for x in encoder.ids(block)] for block in blocks] == wanted
