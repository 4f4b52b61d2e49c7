"""Packing: bounded-space online bin packing of token sequences.

Each partition keeps ``windows`` open sequences of at most ``size`` tokens.
A document is tokenised, closed with ``end_id`` and cut into whole sequences
and a rest. The rest goes to the open window that it fills best. Where none
has room, the fullest is emitted: if at least ``least_cut`` tokens of it are
free, the head of the rest fills it up, else it is padded. At the end of a
partition its open windows are left over; those of ``merge`` neighbouring
partitions are packed once more by the same rule, so that the memory of any
task is bounded by ``windows * merge`` sequences.

Null text is empty: such a document is its end token alone. A null doc_id is
an id like any other. Equal documents are packed one by one. Sequence ids are
the partition's number times 2**40 plus a counter, so that a task that runs
again on the same rows gives the same ids.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, table, tidy

SIZE, WINDOWS, MERGE, LEAST_CUT, END = 1024, 64, 64, 16, 0
SPECIAL = "<|endoftext|>"
_encoders: dict[tuple, object] = {}


def encoder(path: str):
    """text -> little-endian uint32 ids, as the ``tokenizers`` library gives them for the file.

    A byte-level BPE without normaliser is run by ``tiktoken`` over the same
    vocabulary and the same merges, which gives the same ids several times
    faster; a text that holds a special token's string goes to ``tokenizers``.
    """
    if path not in _encoders:
        import json
        import os

        given = path
        if not os.path.exists(path):  # the driver's path: the same file of this machine's installation
            import public_tokenizers

            path = public_tokenizers.path(os.path.basename(path))

        import tiktoken
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        whole: list[Tokenizer] = []  # made when first needed
        pre = spec.get("pre_tokenizer") or {}
        plain = not spec.get("normalizer") and spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
        special = [t["content"] for t in spec.get("added_tokens", [])]

        def slow(text: str) -> bytes:
            if not whole:
                whole.append(Tokenizer.from_file(path))
            return np.asarray(whole[0].encode(text, add_special_tokens=False).ids, "<u4").tobytes()

        if not plain:
            _encoders[given] = slow
        else:
            # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
            own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
            rest = [b for b in range(256) if b not in own]
            byte = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}
            ranks = {bytes(byte[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

            def quick(text: str) -> bytes:
                if any(s in text for s in special):
                    return slow(text)
                return bytes(fast._core_bpe.encode_to_tiktoken_buffer(text, set()))

            _encoders[given] = quick
        path = given
    return _encoders[path]


class Packer:
    """The open windows of one partition; a window is [free, pieces]."""

    def __init__(self, size: int, windows: int, least_cut: int) -> None:
        self.size, self.windows, self.least_cut = size, windows, least_cut
        self.frees: list[tuple[int, int]] = []  # (free, window), ascending
        self.pieces: dict[int, list] = {}
        self.made = 0

    def add(self, doc, start: int, ids: bytes, total: int) -> Iterator[list]:
        """Place one piece of at most ``size`` tokens; yields the windows that it closes."""
        n = len(ids) // 4
        while True:
            k = bisect.bisect_left(self.frees, (n, -1))
            if k < len(self.frees):
                free, window = self.frees.pop(k)
                self.pieces[window].append((doc, start, ids, total))
                if free == n:
                    yield self.pieces.pop(window)
                else:
                    bisect.insort(self.frees, (free - n, window))
                return
            if len(self.frees) < self.windows:
                self.made += 1
                if n == self.size:
                    yield [(doc, start, ids, total)]
                    return
                self.pieces[self.made] = [(doc, start, ids, total)]
                bisect.insort(self.frees, (self.size - n, self.made))
                return
            free, window = self.frees.pop(0)
            full = self.pieces.pop(window)
            if free >= self.least_cut and n - free >= self.least_cut:
                full.append((doc, start, ids[: 4 * free], total))
                start, ids, n = start + free, ids[4 * free :], n - free
            yield full

    def rest(self) -> Iterator[list]:
        for _, window in self.frees:
            yield self.pieces[window]


NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "part"]
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, part long"


class _Out:
    def __init__(self, base: int) -> None:
        self.rows, self.count, self.held = [], base << 40, 0

    def put(self, pieces: list, part: int | None) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, ids, total, self.count, offset, part))
            offset += n
            self.held += len(ids)
        self.count += 1

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*self.rows, strict=True), KINDS, strict=True)], NAMES)
        self.rows, self.held = [], 0
        return out


def pack(
    documents: DataFrame,
    tokenizer: str,
    size: int = SIZE,
    windows: int = WINDOWS,
    merge: int = MERGE,
    least_cut: int = LEAST_CUT,
    end_id: int = END,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset."""
    if not 0 < least_cut <= size:
        raise ValueError("least_cut must be from 1 to size")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        here = TaskContext.get().partitionId()
        encode, packer, out = encoder(tokenizer), Packer(size, windows, least_cut), _Out(here)
        close = np.uint32(end_id).astype("<u4").tobytes()
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = (encode(text) if text else b"") + close
                total = len(ids) // 4
                for start in range(0, total, size):
                    for full in packer.add(doc, start, ids[4 * start : 4 * (start + size)], total):
                        out.put(full, None)
                if out.held >= 4 << 20 or len(out.rows) >= 20000:
                    yield out.batch()
        for open_window in packer.rest():
            out.put(open_window, here)
        if out.rows:
            yield out.batch()

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, packer, out = None, None, None
        for b in batches:
            doc, start, ids, total, group_of = (b.column(k).to_pylist() for k in range(5))
            for d, s, i, t, g in zip(doc, start, ids, total, group_of, strict=True):
                if g != group:
                    if packer:
                        for left in packer.rest():
                            out.put(left, None)
                    group, packer = g, Packer(size, windows, least_cut)
                    base = out
                    out = _Out((1 << 22) + g)  # beyond the numbers of partitions
                    if base:
                        out.rows, out.held = base.rows, base.held
                for full in packer.add(d, s, i, t):
                    out.put(full, None)
                if out.held >= 4 << 20:
                    yield out.batch()
        if packer:
            for left in packer.rest():
                out.put(left, None)
        if out and out.rows:
            yield out.batch()

    bounded_batches(documents.sparkSession)
    made = materialize(documents.select("doc_id", "text").mapInArrow(tidy(first), SCHEMA), "packed")
    left = made.where("part is not null").withColumn("g", F.floor(F.col("part") / merge))
    left = left.select("doc_id", "start", "ids", "doc_tokens", "g", F.negative("length").alias("less"), F.crc32("ids").alias("crc"))
    merged = left.repartition("g").sortWithinPartitions("g", "less", "doc_id", "start", "doc_tokens", "crc").drop("less", "crc").mapInArrow(tidy(again), SCHEMA)
    return made.where("part is null").union(merged).drop("part")


def query(spark, sf_dir):
    import public_tokenizers

    packed = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
