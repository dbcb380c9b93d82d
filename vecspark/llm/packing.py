"""Hierarchical multi-length packing of token ids into training sequences.

Documents are routed by what is left after their full windows: each remainder goes to the tier of the smallest
window that holds it. Long windows are opened by their own tier and their gaps filled from shorter tiers, longest
fitting piece first, at last by a cut piece; what the long tier leaves is packed into windows of its own tier in the
same way. Pieces that no longer fill a window wait for the next chunk of documents, and a partition ends with
windows at powers of two, so nothing is padded. Sequences of one window size, of all tasks, are numbered on and dealt
into step groups of equal tokens, so that for each window size all groups but the last are full.

Each partition packs its own documents in chunks of bounded size, so no text is shuffled and a lost task is redone
from its input split alone; sequence ids start with the partition. Step groups need only how many sequences of a window
size each task has made.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecspark.llm.shared import load, written
from vecspark.llm.tokens import blocks, texts

#: Windows from long to short; the longest is the sequence length.
TIERS = (2048, 1024, 512, 256)
END_ID = 1
#: Tokens of a step group, and tokens that a chunk gathers before it is packed.
STEP_TOKENS, CHUNK_TOKENS = 16 * 2048, 1 << 19
#: Words and stems whose ids a task remembers.
CACHED_WORDS = 600_000
ALNUM = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")
#: The characters that byte-level models write for the bytes of these letters which Latin-1 doesn't print.
BYTE_LETTERS = {"\x9f": "\u0141", "\xa0": "\u0142", "\xad": "\u0143"}
#: Upper-case letters of Latin-1 beyond ASCII, which all stand 32 below their lower-case forms.
UPPER = re.compile(rb"\xc3([\x80-\x96\x98-\x9e])")


class Encoder:
    """Ids of texts by a public tokenizer that lower-cases and drops white space, so that words encode by themselves.

    So do a stem that ends in an ASCII letter or digit and the punctuation after it, as the tokenizer splits there;
    stems recur far more often than words. Words and their parts are remembered as the bytes of their ids.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # without what comes before the model, of which runs of letters need nothing but to be kept apart
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        closing = self.tokenizer.model.end_of_word_suffix
        self.ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, dtype=bool)
        self.ends[[i for piece, i in self.tokenizer.get_vocab().items() if closing and piece.endswith(closing)]] = True
        self.letters = LETTERS if closing else lambda part: None
        self.known: dict[bytes, bytes] = {}

    def _learn(self, new: set[bytes]) -> None:
        runs = list(filter(self.letters, new))
        words = list(new.difference(runs))
        joined = b"\n".join(words)
        lowered = UPPER.sub(lambda m: b"\xc3" + bytes([m[1][0] + 32]), joined.lower()).split(b"\n") if words else []
        if b"<|" in joined:  # special tokens are found before lower-casing
            lowered = [old if b"<|" in old else low for old, low in zip(words, lowered, strict=True)]
        stems = [stem if (stem := word.rstrip(b".,;:!?")) and stem[-1] in ALNUM else word for word in lowered]
        rests = [word[len(stem) :] for word, stem in zip(lowered, stems, strict=True)]
        unknown = {*stems, *rests}.difference(self.known, runs)
        more = list(filter(self.letters, unknown))
        runs += more
        self.known.update(zip(runs, self._runs(runs), strict=True))
        others = list(unknown.difference(more))
        for at in range(0, len(others), 10_000):
            those = others[at : at + 10_000]
            encoded = self.tokenizer.encode_batch_fast(list(map(bytes.decode, those)), add_special_tokens=False)
            self.known.update(zip(those, [array("I", x.ids).tobytes() for x in encoded], strict=True))
        known = self.known
        known.update(zip(words, [known[a] + known[b] if b else known[a] for a, b in zip(stems, rests, strict=True)], strict=True))

    def _runs(self, runs: list[bytes]) -> Iterator[bytes]:
        """The ids of runs of letters, many in one text: each ends with an id that ends a word."""
        lines = [letters(b" ".join(runs[at : at + 1000])) for at in range(0, len(runs), 1000)]
        for encoded in self.model.encode_batch_fast(lines, add_special_tokens=False):
            ids = np.array(encoded.ids, dtype="<u4")
            stop, raw = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist(), ids.tobytes()
            yield from [raw[a:b] for a, b in zip([0, *stop], stop, strict=False)]

    def ids(self, raw: list[bytes | None]) -> list[np.ndarray]:
        lists = [t.split() if t else [] for t in raw]
        every = set(chain.from_iterable(lists))
        new = every.difference(self.known)
        if new:
            if len(self.known) + 2 * len(new) > CACHED_WORDS:  # those that come again now are kept
                self.known = {word: self.known[word] for word in every.difference(new)}
            gc.disable()  # nothing here is cyclic, and there are many objects to trace
            try:
                self._learn(new)
            finally:
                gc.enable()
        get, end = self.known.__getitem__, np.array([END_ID], dtype="<u4").tobytes()
        return [np.frombuffer(b"".join(map(get, words)) + end, dtype="<u4") for words in lists]


#: Whether a part is one run of the lower-case letters of Latin-1, which the tokenizer's model takes as it is.
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch


def letters(line: bytes) -> str:
    """Runs of letters and the spaces between them in the alphabet of bytes that the model merges."""
    if line.isascii():
        return line.decode()
    out = line.decode("latin-1")
    for byte, letter in BYTE_LETTERS.items():
        out = out.replace(byte, letter)
    return out


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One for each Python worker, which keeps what it has learned from task to task."""
    return Encoder(path)


class Packer:
    """Packs (document, ids) into sequences of (document, start, length) pieces; keeps what fills no window yet."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.window = tiers, tiers[0]
        self.pools: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}  # sorted by length

    def tier_of(self, n: int) -> int:
        return min(t for t in self.tiers if t >= n)

    def route(self, doc: int, start: int, n: int) -> None:
        insort(self.pools[self.tier_of(n)], (n, doc, start))

    def add(self, doc: int, n: int) -> Iterator[tuple[int, list]]:
        """The document's full windows; its remainder is routed."""
        for start in range(0, n - n % self.window, self.window):
            yield self.window, [(doc, start, self.window)]
        if n % self.window:
            self.route(doc, n - n % self.window, n % self.window)

    def total(self, most: int) -> int:
        return sum(n for t in self.tiers if t <= most for n, _, _ in self.pools[t])

    def fill(self, window: int) -> list[tuple[int, int, int]]:
        """One sequence of exactly window tokens, from its tier and shorter ones; they must hold as much."""
        pieces, gap = [], window
        while gap:
            fitting = [t for t in self.tiers if t <= window and self.pools[t] and self.pools[t][0][0] <= gap]
            if fitting:
                pool = self.pools[max(fitting)]
                n, doc, start = pool.pop(bisect_right(pool, (gap, 1 << 62, 0)) - 1)
            else:
                pool = self.pools[min(t for t in self.tiers if t <= window and self.pools[t])]
                n, doc, start = pool.pop(0)
                self.route(doc, start + gap, n - gap)
                n = gap
            pieces.append((doc, start, n))
            gap -= n
        return pieces

    def drain(self) -> Iterator[tuple[int, list]]:
        """Long windows while the long tier has openers, then windows of each shorter tier."""
        for window in self.tiers:
            held = self.total(window)
            while held >= window and (self.pools[window] or window == self.tiers[-1]):
                yield window, self.fill(window)
                held -= window
        while self.total(self.window) >= self.window:
            yield self.window, self.fill(self.window)

    def finish(self) -> Iterator[tuple[int, list]]:
        """The rest, in windows at falling powers of two."""
        yield from self.drain()
        left = self.total(self.window)
        rest = sorted((p for pool in self.pools.values() for p in pool), reverse=True)
        self.pools = {t: [] for t in self.tiers}
        while left:
            window = 1 << (left.bit_length() - 1)
            pieces, gap = [], window
            while gap:
                n, doc, start = rest.pop(0)
                if n > gap:
                    rest.insert(0, (n - gap, doc, start + gap))
                    n = gap
                pieces.append((doc, start, n))
                gap -= n
            yield window, pieces
            left -= window


SCHEMA = (
    "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long, _task long, _place long"
)


def pack(docs: DataFrame, tokenizer: str | None = None, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window, step_id), a row for each piece.

    tokenizer: the path of a tokenizers file that drops white space; word_bpe_49k by default. A null or empty text
    has the end id alone; a very long one is cut into many sequences. Every row of docs is a document of its own, also
    where ids repeat or are null. An empty table has no pieces; other columns are ignored. step_id names the step group:
    STEP_TOKENS in sequences of one window.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        packer = Packer(tiers)
        held: dict[int, tuple] = {}  # documents with pieces that wait
        base, count, in_tier = TaskContext.get().partitionId() << 32, 0, {}
        made, gathered, serial, arrow = [], 0, 0, None

        def out(sequences) -> pa.RecordBatch:
            nonlocal count
            rows = []
            for window, pieces in sequences:
                place = in_tier[window] = in_tier.get(window, -1) + 1
                offset = 0
                for doc, start, n in pieces:
                    doc_id, ids = held[doc]
                    crc = zlib.crc32(ids[start : start + n].tobytes())
                    rows.append((doc_id, start, n, crc, len(ids), base + count, offset, window, base >> 32, place))
                    offset += n
                count += 1
            waiting = {doc for pool in packer.pools.values() for _, doc, _ in pool}
            for doc in held.keys() - waiting:
                del held[doc]
            columns = list(zip(*rows, strict=True)) or [()] * 10
            return pa.RecordBatch.from_arrays([pa.array(columns[0], arrow), *(pa.array(c, pa.int64()) for c in columns[1:])], names=names)

        names = ["doc_id", *(x.split()[0] for x in SCHEMA.split(", "))]
        for batch in batches:
            arrow = batch.schema.field("doc_id").type
            for block in blocks(batch):
                for doc_id, ids in zip(block.column("doc_id").to_pylist(), encoder(tokenizer).ids(texts(block)), strict=True):
                    held[serial] = (doc_id, ids)
                    made += packer.add(serial, len(ids))
                    serial, gathered = serial + 1, gathered + len(ids)
                    if gathered >= CHUNK_TOKENS:
                        yield out([*made, *packer.drain()])
                        made, gathered = [], 0
        if serial:
            yield out([*made, *packer.finish()])

    return in_step_groups(written(docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, {SCHEMA}"), "pieces"))


def in_step_groups(pieces: DataFrame) -> DataFrame:
    """Written pieces with step_id in place of _task and _place, the task that made a sequence and its number there
    among those of its window."""
    made = pieces.where("offset = 0").groupBy("window", "_task").agg(F.count("*").alias("_made"))
    earlier = W.partitionBy("window").orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    before = made.select("window", "_task", F.coalesce(F.sum("_made").over(earlier), F.lit(0)).alias("_before"))
    size = F.greatest(F.lit(1), F.floor(STEP_TOKENS / F.col("window")))
    step = F.shiftleft(F.col("window"), 40) + F.floor((F.col("_before") + F.col("_place")) / size)
    return pieces.join(before, ["window", "_task"]).withColumn("step_id", step).select("doc_id", *(x.split()[0] for x in SCHEMA.split(", ")[:-2]), "step_id")


def op8(spark, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return pack(load(spark, sf_dir, "documents"))
