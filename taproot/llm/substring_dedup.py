"""Repeated passages: every word that a repeated window of words covers is removed.

A window is `WINDOW` words in a row of one document; it repeats if its word sequence starts anywhere else. Difference
covers make the search sparse. With a cover D modulo v, any two positions i and j have a shift d < v with both i + d
and j + d at cover positions, so two equal windows share an equal anchor (`WINDOW - v + 1` words) at aligned cover
positions. Hence:

1. Only anchors at cover positions are hashed and shuffled; a hash that occurs twice marks its positions.
2. Windows around marked anchors are candidates: the match is extended to the whole window by a 96-bit hash of its
   words (64 and 32 bits, from two unlike hashes of the words' bytes), shuffled the same way. Only windows that occur
   twice count.
3. Each document drops the words that such windows cover.

Texts travel in chunks of about `CHUNK` bytes, stored once. A chunk asks each bucket of hashes with the sorted distinct
hashes that it has there, and gets a bitmap back, so no pair of positions is made, a passage in a third of all rows
is asked once per chunk, and what is shuffled is a few bytes per anchor.

Null texts have no words; texts shorter than a window keep all of them; a very long text is a chunk of its own (a task's
memory follows the longest text); a window that repeats within its own document counts; of equal windows (ties) none is
kept; repeated rows are each other's copies; an empty table gives an empty table; other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taproot.llm import common
from taproot.llm.wordhash import U64, Words

WINDOW = 35
#: A difference cover modulo 21: each residue is a difference of two members.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
#: Bytes of text after which a chunk is closed; hashes in a bucket, about.
CHUNK, BUCKET = 4_000_000, 1_000_000

ASK = "bucket int, chunk long, kind int, n int, hashes binary, twice binary"
ANSWER = "chunk long, kind int, bucket int, bits binary"


def chunked(docs: DataFrame) -> DataFrame:
    """(chunk, n_words, payload) with whole (doc_id, text) rows in each payload, zstd-compressed Arrow."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        schema = pa.schema([("doc_id", pa.int64()), ("text", pa.large_string())])
        ids: list = []
        texts: list = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal chunk, ids, texts, size
            out = io.BytesIO()
            with pa.ipc.new_stream(out, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.large_string())], schema=schema))
            row = pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([size]), pa.array([out.getvalue()], pa.binary())], names=["chunk", "size", "payload"])
            chunk, ids, texts, size = chunk + 1, [], [], 0
            return row

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(doc)
                texts.append(text)
                size += len(text or "") + 16
                if size >= CHUNK:
                    yield close()
        if ids:
            yield close()

    return common.stored(docs.select("doc_id", "text").mapInArrow(chunks, "chunk long, size long, payload binary"), "uncompressed")


def unpacked(payload: bytes) -> tuple[list, list]:
    t = pa.ipc.open_stream(payload).read_all()
    return t.column("doc_id").to_pylist(), t.column("text").to_pylist()


class Passages:
    """The anchors and candidate windows of one chunk."""

    def __init__(self, texts: list, window: int) -> None:
        self.w, self.window = Words(texts), window
        self.anchor = window - PERIOD + 1
        at = np.isin(self.w.place % PERIOD, COVER) & (self.w.left >= self.anchor) & (self.w.place + self.w.left >= window)
        self.anchors = np.flatnonzero(at)
        self.anchor_codes = self.w.windows(self.anchors, self.anchor)

    def marked(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which words lie in some [start, end)."""
        steps = np.zeros(len(self.w.place) + 1, np.int32)
        np.add.at(steps, starts, 1)
        np.subtract.at(steps, ends, 1)
        return np.cumsum(steps[:-1]) > 0

    def candidates(self, repeated: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold an anchor that ``repeated`` marks."""
        p = self.anchors[repeated]
        first = np.maximum(p - (PERIOD - 1), p - self.w.place[p])
        return np.flatnonzero(self.marked(first, p + 1) & (self.w.left >= self.window))


def distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct codes, whether each occurs twice, the distinct code of each)."""
    own, inverse, counts = np.unique(codes, return_inverse=True, return_counts=True)
    return own, counts > 1, inverse.reshape(-1)


def dealt(codes: np.ndarray, more: np.ndarray | None, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct codes as rows of bytes, whether each occurs twice, the distinct code of each, the order by bucket, the buckets in it)."""
    if more is None:
        own, twice, inverse = distinct(codes)
        rows = own[:, None].view(np.uint8).reshape(-1, 8)[:, :6]  # the bucket and 48 bits; false anchors are only candidates
        place = own >> U64(32)
    else:
        both = np.empty(len(codes), dtype=[("a", "<u8"), ("b", "<u4")])
        both["a"], both["b"] = codes, more.astype(np.uint32)
        own, twice, inverse = distinct(both)
        rows, place = own.view(np.uint8).reshape(-1, 12), own["a"] >> U64(32)
    bucket = (place % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return rows, twice, inverse, order, bucket[order]


def asked(chunk: int, kind: int, codes: np.ndarray, more: np.ndarray | None, buckets: int) -> Iterator[dict]:
    """A row per bucket with the chunk's distinct codes there; with ``more``, 4 bytes of a second hash each."""
    rows, twice, _, order, bucket = dealt(codes, more, buckets)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        i = order[a:b]
        yield {"bucket": int(bucket[a]), "chunk": chunk, "kind": kind, "n": len(i), "hashes": rows[i].tobytes(), "twice": np.packbits(twice[i]).tobytes()}


def answered(asked_rows: DataFrame) -> DataFrame:
    """A bitmap for each asking row: which of its hashes occur twice, there or with another chunk's."""

    def answer(rows: pa.Table) -> pa.Table:
        got = rows.to_pylist()
        width = 6 if got[0]["kind"] == 0 else 12
        codes = np.frombuffer(b"".join(r["hashes"] for r in got), np.dtype((np.void, width)))
        wide = np.zeros((len(codes), 16), np.uint8)
        wide[:, :width] = codes.view(np.uint8).reshape(-1, width)
        low, high = wide.view("<u8").T
        order = np.lexsort((high, low)) if width > 8 else np.argsort(low, kind="stable")
        same = (low[order][1:] == low[order][:-1]) & (high[order][1:] == high[order][:-1])
        twice = np.zeros(len(codes), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        out, at = [], 0
        for r in got:
            own = twice[at : at + r["n"]] | np.unpackbits(np.frombuffer(r["twice"], np.uint8), count=r["n"]).astype(bool)
            at += r["n"]
            if own.any():
                out.append({"chunk": r["chunk"], "kind": r["kind"], "bucket": r["bucket"], "bits": np.packbits(own).tobytes()})
        return pa.Table.from_pylist(out, pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("bits", pa.binary())]))

    return asked_rows.groupBy("bucket").applyInArrow(answer, ANSWER)


def told(codes: np.ndarray, more: np.ndarray | None, answers: dict[int, bytes], buckets: int) -> np.ndarray:
    """Which of the chunk's codes occur twice, from the bitmaps that answer `asked`."""
    rows, _, inverse, order, bucket = dealt(codes, more, buckets)
    found = np.zeros(len(rows), bool)
    for b, bits in answers.items():
        i = order[slice(*np.searchsorted(bucket, (b, b + 1)))]
        found[i] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(i)).astype(bool)
    return found[inverse]


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of (doc_id, text): doc_id, n_words, n_removed, kept (the words left, joined by a space), spans.

    ``spans`` are [first, last) word ranges that were removed. ``window`` is at least PERIOD words.
    """
    if window < PERIOD:
        raise ValueError(f"a window has at least {PERIOD} words")
    chunks = chunked(docs)
    size = chunks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    buckets = min(size * len(COVER) // (6 * PERIOD) // BUCKET + 1, 1 << 31)  # all that 32 bits name: 9 PB of text
    ask_schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("n", pa.int32()), ("hashes", pa.binary()), ("twice", pa.binary())])

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                p = Passages(unpacked(payload)[1], window)
                yield pa.RecordBatch.from_pylist(list(asked(chunk, 0, p.anchor_codes, None, buckets)), schema=ask_schema)

    first = common.stored(answered(chunks.select("chunk", "payload").mapInArrow(anchors, ASK)))

    def repeated(p: Passages, answers: pa.Table) -> tuple[np.ndarray, dict[int, dict[int, bytes]]]:
        by: dict[int, dict[int, bytes]] = {0: {}, 1: {}}
        for r in answers.to_pylist():
            by[r["kind"]][r["bucket"]] = r["bits"]
        return p.candidates(told(p.anchor_codes, None, by[0], buckets)), by

    def windows(own: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[dict] = []
        for chunk, payload in zip(own["chunk"].to_pylist(), own["payload"].to_pylist(), strict=True):
            p = Passages(unpacked(payload)[1], window)
            at, _ = repeated(p, answers)
            out += asked(chunk, 1, p.w.windows(at, window), p.w.windows2(at, window), buckets)
        return pa.Table.from_pylist(out, ask_schema)

    grouped = chunks.select("chunk", "payload").repartition(common.partitions(docs), "chunk").groupBy("chunk")
    second = answered(grouped.cogroup(first.groupBy("chunk")).applyInArrow(windows, ASK))

    def cut(own: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {"doc_id": [], "n_words": [], "n_removed": [], "kept": [], "spans": []}
        for payload in own["payload"].to_pylist():
            ids, texts = unpacked(payload)
            p = Passages(texts, window)
            at, by = repeated(p, answers)
            at = at[told(p.w.windows(at, window), p.w.windows2(at, window), by[1], buckets)]
            gone = p.marked(at, at + window)
            for doc, words, a, b in zip(ids, p.w.words, p.w.firsts.tolist(), p.w.ends.tolist(), strict=True):
                own_gone = gone[a:b]
                n = int(own_gone.sum())
                edges = np.flatnonzero(np.diff(np.concatenate([[False], own_gone, [False]]).astype(np.int8))) if n else np.zeros(0, np.int64)
                out["doc_id"].append(doc)
                out["n_words"].append(len(words))
                out["n_removed"].append(n)
                out["kept"].append((b" ".join(compress(words, (~own_gone).tolist())) if n else b" ".join(words)).decode())
                out["spans"].append([{"first": int(x), "last": int(y)} for x, y in edges.reshape(-1, 2)])
        span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        return pa.table({"doc_id": pa.array(out["doc_id"], pa.int64()), "n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "kept": pa.array(out["kept"], pa.string()), "spans": pa.array(out["spans"], span)})

    schema = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<first: int, last: int>>"
    return grouped.cogroup(first.unionByName(second).groupBy("chunk")).applyInArrow(cut, schema)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH w AS (SELECT rowid AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)),
i AS (SELECT r, unnest(generate_series(1, len(ws) - 34)) AS s, ws FROM w WHERE len(ws) >= 35),
h AS (SELECT r, s, md5(array_to_string(ws[s : s + 34], ' ')) AS k FROM i),
d AS (SELECT r, s FROM h WHERE k IN (SELECT k FROM h GROUP BY k HAVING count(*) > 1)),
g AS (SELECT DISTINCT r, s + o AS p FROM d, (SELECT unnest(generate_series(0, 34)) AS o)),
l AS (SELECT r, list(p) AS ps FROM g GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, j: NOT list_contains(ps, j)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN l USING (r)
"""
