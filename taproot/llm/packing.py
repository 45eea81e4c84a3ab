"""Packing of token sequences by best-fit decreasing.

Overlong documents are first cut into full windows; what is left of each document is packed, the longest first, into
the open window with the least room that still holds it. A segment tree over the windows' remaining capacities finds
that window in O(log capacity).

Every partition packs its own documents, `GROUP` at a time, so nothing is shuffled and a task holds the lengths of
one group. The cost is at most a few windows per group.

Null texts count as empty, an empty text is the end id alone, repeated rows are packed as often as they occur, pieces
of one length (ties) keep the order of their rows, a very long text is cut into full windows (a task's memory follows
the longest text), an empty table gives no piece; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taproot.llm import common
from taproot.llm.encoding import SpacedWords, encoder, groups

#: Documents whose remainders are packed together.
GROUP = 200_000

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, padding long"


class CapacityTree:
    """A segment tree over 0..capacity that counts the open windows by room left."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.size)

    def add(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.counts[at] += by
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """The least room that is at least ``need``."""
        counts, at = self.counts, need + self.size
        if counts[at]:
            return need
        while at > 1:
            if not at & 1 and counts[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if counts[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """(window of each item, its offset there, each window's length). Items of one length keep their order."""
    tree, open_by_room = CapacityTree(capacity), [[] for _ in range(capacity + 1)]
    windows, offsets, filled = [0] * len(lengths), [0] * len(lengths), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        room = tree.tightest(n)
        if room is None:
            w, room = len(filled), capacity
            filled.append(0)
        else:
            w = open_by_room[room].pop()
            tree.add(room, -1)
        windows[i], offsets[i] = w, filled[w]
        filled[w] += n
        if room > n:
            open_by_room[room - n].append(w)
            tree.add(room - n, 1)
    return windows, offsets, filled


def padded(length: int, capacity: int) -> int:
    """The length after padding: a power of two stays, all else is filled up to the capacity."""
    return length if length & (length - 1) == 0 else capacity


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024, words=SpacedWords, group: int = GROUP) -> DataFrame:
    """The pieces of (doc_id, text) and their places. A sequence_id is the task's number times 2^40 plus a count."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        enc = encoder(tokenizer, words)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "padding"]
        types = [pa.int64()] * len(names)
        rest: list[tuple] = []

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal first, rest
            windows, offsets, filled = best_fit_decreasing([r[2] for r in rest], capacity)
            own = [(*r, first + w, o, filled[w], padded(filled[w], capacity) - filled[w]) for r, w, o in zip(rest, windows, offsets, strict=True)]
            first, rest = first + len(filled), []
            for i in range(0, len(own), 10_000):
                yield batch(own[i : i + 10_000])

        for b in batches:
            for g in groups(b, 1):
                codes, sizes = enc.encode(g.column(1), end_id)
                view, begin, full = memoryview(codes), 0, []
                for doc, n in zip(g.column(0).to_numpy(zero_copy_only=False).tolist() if not g.column(0).null_count else g.column(0).to_pylist(), sizes.tolist(), strict=True):
                    cut = n - n % capacity
                    for at in range(0, cut, capacity):
                        full.append((doc, at, capacity, zlib.crc32(view[4 * (begin + at) : 4 * (begin + at + capacity)]), n, first, 0, capacity, 0))
                        first += 1
                    if cut < n:
                        rest.append((doc, cut, n - cut, zlib.crc32(view[4 * (begin + cut) : 4 * (begin + n)]), n))
                    begin += n
                if full:
                    yield batch(full)
                if len(rest) >= group:
                    yield from packed()
        if rest:
            yield from packed()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(common.sparing(pieces), PIECE_SCHEMA)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
