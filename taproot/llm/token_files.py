"""Token ids in binary files: one wavelet matrix per shard, with rank and select.

A shard is a row of a Parquet table (zstd): the bit-planes of a wavelet matrix over its ids, the zeros of each
plane, a rank directory of a count per 4096 bits, and the ids' bounds by document. From that row alone `WaveletMatrix`
answers access (the id at a position), rank (occurrences of an id before a position), count and select (the
position of its k-th occurrence), and gives the whole sequence back. `counts` and `occurrences` ask all stored shards,
`tokens` the one that holds a position. An id that needs more bits than a shard has planes is an error.

Null texts count as empty, an empty text is the end id alone, repeated rows are encoded as often as they occur, ties
of doc_id lie in any order, a very long text makes a shard of its own (a task's memory follows the longest text), an
empty table gives an empty table; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taproot.llm import common
from taproot.llm.encoding import LoweredWords, encoder, groups

#: Ids after which a shard is closed; a shard holds whole documents.
SHARD_IDS = 1 << 19
RANK_BITS = 4096

SHARD_SCHEMA = "part int, shard int, start long, n_ids long, bits int, zeros array<int>, planes array<binary>, ranks array<binary>, doc_ids binary, doc_nulls binary, lengths binary"


class WaveletMatrix:
    """Bit-planes from the highest bit down; each plane is over the ids stably sorted by the bits above it."""

    def __init__(self, n: int, bits: int, zeros: list[int], planes: list[bytes], ranks: list[bytes]) -> None:
        self.n, self.bits, self.zeros, self.planes = n, bits, zeros, planes
        self.ranks = [np.frombuffer(r, "<u4") for r in ranks]

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        if len(ids) and int(ids.max()) >> bits:
            raise ValueError(f"an id of {int(ids.max())} needs more than {bits} bits")
        ids = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        zeros, planes, ranks = [], [], []
        for bit in reversed(range(bits)):
            one = ((ids >> bit) & 1).astype(bool)
            packed = np.packbits(one, bitorder="little")
            ends = np.bitwise_count(np.pad(packed, (0, -len(packed) % (RANK_BITS // 8))).reshape(-1, RANK_BITS // 8)).sum(1, dtype=np.uint32)
            ranks.append(np.concatenate([[0], np.cumsum(ends)]).astype("<u4").tobytes())
            at0, at1 = np.flatnonzero(~one), np.flatnonzero(one)
            zeros.append(len(at0))
            planes.append(packed.tobytes())
            ids = np.concatenate([ids.take(at0), ids.take(at1)])
        return cls(len(ids), bits, zeros, planes, ranks)

    def all(self) -> np.ndarray:
        """The whole sequence: the sorting of each plane is undone, the lowest plane first."""
        ids = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in reversed(range(self.bits)):
            one = np.unpackbits(np.frombuffer(self.planes[level], np.uint8), count=self.n, bitorder="little").view(bool)
            back = np.empty_like(ids)
            back[~one] = ids[: self.zeros[level]]
            back[one] = ids[self.zeros[level] :] | ids.dtype.type(1 << (self.bits - 1 - level))
            ids = back
        return ids

    def _rank1(self, level: int, i: int) -> int:
        block, rest = divmod(i, RANK_BITS)
        first = block * RANK_BITS // 8
        part = np.frombuffer(self.planes[level], np.uint8)[first : first + rest // 8 + 1]
        whole = int(np.bitwise_count(part[: rest // 8]).sum())
        last = int(part[rest // 8]) & ((1 << rest % 8) - 1) if rest % 8 else 0
        return int(self.ranks[level][block]) + whole + last.bit_count()

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.bits):
            bit = self.planes[level][i // 8] >> (i % 8) & 1
            ones = self._rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, i: int) -> tuple[int, int]:
        lo, hi = 0, i
        for level in range(self.bits):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if value >> (self.bits - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, value: int, i: int) -> int:
        """Occurrences of ``value`` before position ``i``."""
        lo, hi = self._range(value, min(i, self.n))
        return hi - lo

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int | None:
        """The position of the occurrence number ``k`` (from 0), or None."""
        lo, hi = self._range(value, self.n)
        if not 0 <= k < hi - lo:
            return None
        at = lo + k
        for level in reversed(range(self.bits)):
            at = self._select(level, at - self.zeros[level], 1) if value >> (self.bits - 1 - level) & 1 else self._select(level, at, 0)
        return at

    def positions(self, value: int) -> np.ndarray:
        """All positions of ``value``, ascending: `select` for every occurrence at once."""
        lo, hi = self._range(value, self.n)
        at = np.arange(lo, hi)
        for level in reversed(range(self.bits)):
            if not len(at):
                break
            one = np.unpackbits(np.frombuffer(self.planes[level], np.uint8), count=self.n, bitorder="little").view(bool)
            at = np.flatnonzero(one)[at - self.zeros[level]] if value >> (self.bits - 1 - level) & 1 else np.flatnonzero(~one)[at]
        return at

    def _select(self, level: int, k: int, bit: int) -> int:
        ends = self.ranks[level].astype(np.int64)
        if not bit:
            ends = np.minimum(np.arange(len(ends)) * RANK_BITS, self.n) - ends
        block = int(np.searchsorted(ends, k, "right")) - 1
        part = np.frombuffer(self.planes[level], np.uint8)[block * RANK_BITS // 8 : (block + 1) * RANK_BITS // 8]
        found = np.flatnonzero(np.unpackbits(part, bitorder="little") == bit)
        return block * RANK_BITS + int(found[k - int(ends[block])])


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, bits: int | None = None, words=LoweredWords, shard_ids: int = SHARD_IDS) -> common.Stored:
    """Encodes ``text`` of (doc_id, text) in ascending doc_id order and stores the shards.

    One range shuffle of the texts; each task then holds one group of texts and one shard at a time. ``part`` ascends
    with doc_id, ``shard`` within a part, ``start`` counts the ids before a shard within its part. ``bits`` are as many
    as the tokenizer's ids and the end id need, unless given.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard, start = TaskContext.get().partitionId(), 0, 0
        enc = encoder(tokenizer, words)
        planes = bits or max(enc.size() - 1, end_id, 1).bit_length()
        docs_held: list[pa.Array] = []
        ids_held: list[np.ndarray] = []
        sizes_held: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal shard, start
            doc = pa.concat_arrays(docs_held)
            w = WaveletMatrix.build(np.concatenate(ids_held), planes)
            row = {
                "part": part,
                "shard": shard,
                "start": start,
                "n_ids": w.n,
                "bits": planes,
                "zeros": w.zeros,
                "planes": w.planes,
                "ranks": [r.tobytes() for r in w.ranks],
                "doc_ids": pc.fill_null(doc, 0).to_numpy().astype("<i8").tobytes(),
                "doc_nulls": np.packbits(doc.is_null().to_numpy(zero_copy_only=False)).tobytes(),
                "lengths": np.concatenate(sizes_held).astype("<u4").tobytes(),
            }
            shard, start = shard + 1, start + w.n
            for held in (docs_held, ids_held, sizes_held):
                held.clear()
            return pa.RecordBatch.from_pylist([row], schema=schema)

        schema = pa.schema(
            [
                *((n, pa.int32()) for n in ("part", "shard")),
                *((n, pa.int64()) for n in ("start", "n_ids")),
                ("bits", pa.int32()),
                ("zeros", pa.list_(pa.int32())),
                *((n, pa.list_(pa.binary())) for n in ("planes", "ranks")),
                *((n, pa.binary()) for n in ("doc_ids", "doc_nulls", "lengths")),
            ]
        )
        for b in batches:
            for g in groups(b, 1):
                codes, sizes = enc.encode(g.column(1), end_id)
                ids, ends, first = np.frombuffer(codes, "<u4"), np.cumsum(sizes), 0
                while first < len(sizes):
                    before = int(ends[first - 1]) if first else 0
                    held = sum(map(len, ids_held))
                    # The first document that fills the shard closes it.
                    last = min(len(sizes), int(np.searchsorted(ends, before + shard_ids - held)) + 1)
                    docs_held.append(g.column(0).slice(first, last - first))
                    ids_held.append(ids[before : int(ends[last - 1])])
                    sizes_held.append(sizes[first:last])
                    if held + len(ids_held[-1]) >= shard_ids:
                        yield close()
                    first = last
        if docs_held:
            yield close()

    order = F.col("doc_id").asc_nulls_first()
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(common.partitions(docs), order).sortWithinPartitions(order)
    return common.Stored(ordered.mapInArrow(shards, SHARD_SCHEMA), compression="zstd")


def read_shards(shards: DataFrame) -> DataFrame:
    """Per document of stored shards: doc_id, start, n_tokens, ids_crc32, part and shard. One shard is in memory at a time."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "local", "n_tokens", "ids_crc32", "part", "shard"]
        for b in batches:
            for r in b.to_pylist():
                lengths = np.frombuffer(r["lengths"], "<u4").astype(np.int64)
                ids = WaveletMatrix(r["n_ids"], r["bits"], r["zeros"], r["planes"], r["ranks"]).all().astype("<u4")
                ends = np.cumsum(lengths)
                view = memoryview(ids).cast("B")
                crcs = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                n = len(lengths)
                null = np.unpackbits(np.frombuffer(r["doc_nulls"], np.uint8), count=n).astype(bool)
                doc = pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=null)
                yield pa.RecordBatch.from_arrays([doc, pa.array(ends - lengths + r["start"]), pa.array(lengths), pa.array(crcs, pa.int64()), pa.array([r["part"]] * n, pa.int32()), pa.array([r["shard"]] * n, pa.int32())], names=names)

    return shards.mapInArrow(decode, "doc_id long, local long, n_tokens long, ids_crc32 long, part int, shard int")


def starts(shards: DataFrame) -> DataFrame:
    """(part, before): the ids of all parts before each part. One row per part reaches the driver."""
    total, rows = 0, []
    for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        rows.append((r["part"], total))
        total += r["n"]
    return shards.sparkSession.createDataFrame(rows, "part int, before long")


_MATRIX = ("n_ids", "bits", "zeros", "planes", "ranks")


def _matrix(r: dict) -> WaveletMatrix:
    return WaveletMatrix(*(r[n] for n in _MATRIX))


def counts(shards: DataFrame, ids: list[int]) -> DataFrame:
    """(id, count) over all stored shards, by rank; an id that occurs nowhere counts 0. ``ids`` is the caller's own short list."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                w = _matrix(r)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([w.count(i) if i >> w.bits == 0 else 0 for i in ids], pa.int64())], names=["id", "n"])

    asked = shards.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], "id long")
    found = shards.select(*_MATRIX).mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return asked.join(found, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("count"))


def occurrences(shards: DataFrame, ids: list[int]) -> DataFrame:
    """(id, doc_id, position, part, shard) of every occurrence, by select; ``position`` counts the ids before it in all shards."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "doc_id", "local", "part", "shard"]
        for b in batches:
            for r in b.to_pylist():
                w, lengths = _matrix(r), np.frombuffer(r["lengths"], "<u4").astype(np.int64)
                ends, null = np.cumsum(lengths), np.unpackbits(np.frombuffer(r["doc_nulls"], np.uint8), count=len(lengths)).astype(bool)
                doc_ids = np.frombuffer(r["doc_ids"], "<i8")
                for i in dict.fromkeys(ids):
                    at = w.positions(i) if i >> w.bits == 0 else np.zeros(0, np.int64)
                    doc, n = np.searchsorted(ends, at, "right"), len(at)
                    columns = [pa.array([i] * n, pa.int64()), pa.array(doc_ids[doc], mask=null[doc]), pa.array(at + r["start"], pa.int64())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([r["part"]] * n, pa.int32()), pa.array([r["shard"]] * n, pa.int32())], names=names)

    own = shards.select(*_MATRIX, "part", "shard", "start", "lengths", "doc_ids", "doc_nulls")
    found = own.mapInArrow(find, "id long, doc_id long, local long, part int, shard int")
    return found.join(F.broadcast(starts(shards)), "part").select("id", "doc_id", (F.col("before") + F.col("local")).alias("position"), "part", "shard")


def tokens(shards: DataFrame, positions: list[int]) -> DataFrame:
    """(position, id) at some positions of the whole sequence, by access in the shards that hold them; others give no row."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                first = r["before"] + r["start"]
                own = [p for p in positions if first <= p < first + r["n_ids"]]
                w = _matrix(r)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([w.access(p - first) for p in own], pa.int64())], names=["position", "id"])

    first = F.col("before") + F.col("start")
    held = F.exists(F.lit(positions) if positions else F.array().cast("array<long>"), lambda p: (p >= first) & (p < first + F.col("n_ids")))
    return shards.join(F.broadcast(starts(shards)), "part").where(held).select(*_MATRIX, "start", "before").mapInArrow(look, "position long, id long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int, bits: int | None = None, words=LoweredWords) -> DataFrame:
    shards = write_shards(docs, tokenizer, end_id, bits, words).read()
    found = read_shards(shards).join(F.broadcast(starts(shards)), "part")
    return found.select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "part", "shard")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
