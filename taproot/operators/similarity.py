"""Text vectors, outliers among neighbours, and word pieces."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taproot.functions.hashing import fnv1a64
from taproot.storage import stored

DIMENSION, GRAM, NEIGHBOURS = 128, 3, 5
#: Vectors that are compared with as many others at once, and bytes that they may take: a pair is a row, and the JVM's heap fills with
#: large rows (over half a region of 1 MB) until they are collected.
BLOCK, BLOCK_BYTES = 1024, 200_000
#: Blocks that a task compares with others at most, of these at most so many bytes; blocks below `TASKS` are a task each.
ASKING, ASKED_BYTES, TASKS = 64, 64 << 20, 32


def gram_counts(rows: DataFrame, text: str, key: str, dimension: int = DIMENSION, gram: int = GRAM) -> DataFrame:
    """(key, bucket, n): how many character n-grams of a text fall into each bucket of their hash."""
    n = F.length(text)
    grams = F.when(n < gram, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - gram + 1, F.lit(1))), lambda i: F.substring(F.col(text), i, gram)))
    exploded = rows.select(key, F.explode(grams).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("n"))
    # 2^64 modulo a power of two up to 2^32 is the low half's.
    return exploded.withColumn("bucket", (fnv1a64(F.col("gram"))["lo"] % dimension).cast("int")).groupBy(key, "bucket").agg(F.sum("n").alias("n"))


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay."""
    norm = np.sqrt((rows * rows).sum(axis=1))
    return rows / np.where(norm == 0, 1, norm)[:, None]


def normalized(vectors: DataFrame) -> DataFrame:
    """(id, v) with vectors of length 1; a zero vector stays."""

    def unit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield f.assign(v=list(_unit(np.stack(f.v.to_list()).astype(np.float64))))

    return vectors.select("id", "v").mapInPandas(unit, "id long, v array<double>")


def anomaly(vectors: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(id, anomaly): 1 - mean cosine with the k most similar others, within 0..1, from (id, v).

    Exact, by `nearest_of_blocks`: time grows with the square of the rows, memory and disk don't.
    """
    return _anomaly(nearest_of_blocks(stored(packed(vectors)), k, ties=False))


def _anomaly(near: DataFrame) -> DataFrame:
    mean = F.aggregate("near", F.lit(0.0), lambda a, x: a + x["similarity"]) / F.greatest(F.size("near"), F.lit(1))
    return near.select("id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - mean)).alias("anomaly"))


def packed(vectors: DataFrame, cells: int = 0) -> DataFrame:
    """A row per block of (id, v) as they lie: its number, ids and vectors as bytes, of float or double as ``v`` is.

    With ``cells`` also each row's own cell and the bits of the cells that it asks, from (home, asks), and which of either a block has.
    """
    most, bytes_, dtype = BLOCK, BLOCK_BYTES, "<f4" if vectors.schema["v"].dataType.elementType.typeName() == "float" else "<f8"
    names = ["id", "v", "home", "asks"] if cells else ["id", "v"]

    def matrix(column: pa.Array) -> np.ndarray:
        lengths = set(column.value_lengths().to_pylist())
        if column.null_count or len(lengths) > 1:
            raise ValueError("vectors must not be null, and of one length")
        return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), lengths.pop())

    def block(parts: list[np.ndarray]) -> pa.RecordBatch:
        columns = [pa.array([x.tobytes()], pa.binary()) for x in parts]
        if cells:
            asked = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(parts[3], axis=0), count=cells))
            columns += [pa.array([np.unique(parts[2]).tolist()], pa.list_(pa.int32())), pa.array([asked.tolist()], pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays([pa.array([len(parts[0])], pa.int32()), *columns], ["n", *names, *(["has", "wants"] if cells else [])])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = []
        for b in batches:
            if not b.num_rows:
                continue
            if b.column("id").null_count:
                raise ValueError("ids must not be null")
            own = [b.column("id").to_numpy(zero_copy_only=False).astype("<i8"), matrix(b.column("v"))]
            if cells:
                own += [b.column("home").to_numpy(zero_copy_only=False).astype("<i4"), np.stack([np.frombuffer(x, np.uint8) for x in b.column("asks").to_pylist()])]
            if rest and rest[1].shape[1] != own[1].shape[1]:
                raise ValueError("vectors must not be null, and of one length")
            rest = [np.concatenate(x) for x in zip(rest, own, strict=True)] if rest else own
            n = max(1, min(most, bytes_ // max(own[1].itemsize * own[1].shape[1], 1)))
            while len(rest[0]) >= n:
                yield block([x[:n] for x in rest])
                rest = [x[n:] for x in rest]
        if rest and len(rest[0]):
            yield block(rest)

    schema = "n int, " + ", ".join(f"{x} binary" for x in names) + (", has array<int>, wants array<int>" if cells else "")
    own = vectors.select(F.col("id").cast("long").alias("id"), F.col("v").cast(f"array<{'float' if dtype == '<f4' else 'double'}>").alias("v"), *names[2:])
    return own.mapInArrow(pack, schema).withColumn("block", F.monotonically_increasing_id()).withColumn("dtype", F.lit(dtype))


def _keep(kept: np.ndarray, others: np.ndarray, sims: np.ndarray, ids: np.ndarray, ties: bool) -> None:
    """Puts into each row of ``kept`` and ``others``, the most similar first, what is better in ``sims`` of ``ids``.

    With ``ties``, of equal similarities the least id is kept, else any. -inf is no similarity.
    """
    k, low, most = kept.shape[1], kept[:, -1], sims.max(axis=1)
    rows = np.flatnonzero((most >= low) & (most > -np.inf) if ties else most > low)
    if not len(rows):
        return
    s, floor = sims[rows], low[rows]
    if s.shape[1] > k:
        floor = np.maximum(floor, np.partition(s, -k, axis=1)[:, -k])
    row, column = np.nonzero((s >= floor[:, None]) & (s > -np.inf))
    at = np.concatenate([np.repeat(np.arange(len(rows)), k), row])
    all_s, all_o = np.concatenate([kept[rows].ravel(), s[row, column]]), np.concatenate([others[rows].ravel(), ids[column]])
    order = np.lexsort((all_o, -all_s, at))
    best = order[np.searchsorted(at[order], np.arange(len(rows)))[:, None] + np.arange(k)]
    kept[rows], others[rows] = all_s[best], all_o[best]


def nearest_of_blocks(blocks: DataFrame, k: int, ties: bool = True) -> DataFrame:
    """(id, near) of stored `packed` blocks: each row's k most similar others, the most similar first, of those whose cell it asks.

    A task takes up to `ASKING` blocks past up to `ASKED_BYTES` of others, and only the best k of each row leave it: the table is
    shuffled twice, whatever the number of pairs, and a row leaves k others for each `ASKED_BYTES` of the table. A task holds these
    bytes and one pair of blocks besides its best.
    """
    count, size = blocks.agg(F.count("*"), F.sum(F.length("v"))).first()
    by_cell = "has" in blocks.columns
    asking = blocks.select("block", "dtype", "n", "id", "v", *(["asks", "wants"] if by_cell else [])).repartition(max(1, -(-count // ASKING), min(count, TASKS)))
    asked = blocks.select(F.col("n").alias("m"), F.col("id").alias("other"), F.col("v").alias("w"), *(["home", "has"] if by_cell else [])).repartition(max(1, -(-(size or 0) // ASKED_BYTES)))
    asked = asked.hint("shuffle_replicate_nl")  # never broadcast, which the driver would hold
    pairs = asking.join(asked, F.arrays_overlap("wants", "has")).drop("wants", "has") if by_cell else asking.crossJoin(asked)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        last, a, finite = None, None, True
        for b in batches:
            for i in range(b.num_rows):
                of = lambda name, dtype: np.frombuffer(b.column(name)[i].as_buffer(), dtype)  # noqa: B023, E731
                number, dtype, n, m = (b.column(x)[i].as_py() for x in ("block", "dtype", "n", "m"))
                if number not in held:
                    held[number] = of("id", "<i8").copy(), np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
                if number != last:
                    last, a = number, _unit(of("v", dtype).reshape(n, -1).astype(np.float64))
                    finite = np.isfinite(a).all()
                ids, kept, others = held[number]
                theirs, w = of("other", "<i8"), _unit(of("w", dtype).reshape(m, -1).astype(np.float64))
                sims = a @ w.T
                if np.isin(ids, theirs).any():
                    sims[ids[:, None] == theirs[None, :]] = -np.inf
                if by_cell:
                    asks = np.unpackbits(of("asks", np.uint8).reshape(n, -1), axis=1)[:, of("home", "<i4")]
                    if not asks.all():
                        sims[asks == 0] = -np.inf
                if not (finite and np.isfinite(w).all()):
                    sims[np.isnan(sims)] = -np.inf
                _keep(kept, others, sims, theirs, ties)
        for ids, kept, others in held.values():
            there = kept > -np.inf
            ends = np.concatenate([[0], there.sum(axis=1).cumsum()]).astype(np.int32)
            found = pa.StructArray.from_arrays([pa.array(-kept[there]), pa.array(others[there])], ["unlike", "other"])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(ends), found)], ["id", "near"])

    found = pairs.mapInArrow(best, "id long, near array<struct<unlike: double, other: long>>")
    every = F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k)  # k per part of those asked
    return found.groupBy("id").agg(F.transform(every, lambda x: F.struct((0 - x["unlike"]).alias("similarity"), x["other"].alias("other"))).alias("near"))


def gram_vectors(rows: DataFrame, text: str, key: str, dimension: int = DIMENSION, gram: int = GRAM) -> DataFrame:
    """(key, v): the counts of `gram_counts` as a vector; zeros for texts that are null or shorter than an n-gram."""
    counts = gram_counts(rows, text, key, dimension, gram).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("n"))  # at most ``dimension`` entries
    at = lambda i: F.coalesce(F.try_element_at("n", i), F.lit(0)).cast("double")
    return rows.select(key).distinct().join(counts, key, "left").select(key, F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), at).alias("v"))


def anomaly_by_index(vectors: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """`anomaly` by `neighbours`: about the k most similar others, for more vectors than can all be compared."""
    return _anomaly(neighbours(vectors, k))


#: Cells of an inverted file at most, and rows that they are fitted on at most.
CELLS, SAMPLE = 4096, 100_000
#: Queries that are answered exactly to tell how many cells to ask, and the share of their neighbours that those cells must hold.
TRIALS, TARGET = 256, 0.95


def fitted_cells(own: DataFrame, cells: int | None = None) -> np.ndarray:
    """Centres of about sqrt(n) cells, by k-means on at most `SAMPLE` rows, those of the least hash of their id."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = own.count()
    wanted = min(cells or max(1, round(n**0.5)), CELLS, max(n, 1))
    if wanted == 1 or not n:
        return np.zeros((1, 1))
    share = min(1.0, SAMPLE / n)
    some = normalized(own.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1)))
    return np.array(KMeans(k=wanted, seed=1, maxIter=10).fit(some.select(array_to_vector("v").alias("features")).repartition(8)).clusterCenters())


def _nearest(v: np.ndarray, centres: np.ndarray, most: int) -> np.ndarray:
    """The cells of vectors, the nearest first; of equally near ones the first."""
    if len(centres) == 1:
        return np.zeros((len(v), 1), np.int64)
    return np.argsort((centres**2).sum(1) / 2 - v @ centres.T, axis=1, kind="stable")[:, :most]


def needed_probes(own: DataFrame, centres: np.ndarray, k: int) -> int:
    """How many cells queries ask to find `TARGET` of their neighbours, by `TRIALS` queries that are compared with all rows.

    The trials are the rows of the least hash. Each batch of rows gives their best k, of which the best are kept.
    """
    own = normalized(own)
    trials = own.orderBy(F.xxhash64("id"), "id").limit(TRIALS).collect()
    if not trials:
        return 1
    ids, asked = np.array([r.id for r in trials]), np.array([r.v for r in trials])

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            v, other = np.stack(f.v.to_list()), f.id.to_numpy()
            cell, sims = _nearest(v, centres, 1)[:, 0], asked @ v.T
            sims[ids[:, None] == other[None, :]] = -np.inf
            top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
            at = np.repeat(np.arange(len(ids)), top.shape[1])
            yield pd.DataFrame({"trial": at, "similarity": sims[at, top.ravel()], "other": other[top.ravel()], "cell": cell[top.ravel()]})

    found = own.mapInPandas(best, "trial int, similarity double, other long, cell int").where(F.col("similarity") > float("-inf"))
    place = F.row_number().over(Window.partitionBy("trial").orderBy(F.desc("similarity"), "other"))
    rows = found.withColumn("place", place).where(F.col("place") <= k).select("trial", "cell").collect()  # k a trial
    ranks = np.argsort(_nearest(asked, centres, len(centres)), axis=1)
    depth = sorted(int(ranks[r.trial, r.cell]) + 1 for r in rows)
    return depth[min(len(depth) - 1, int(np.ceil(TARGET * len(depth))))] if depth else 1


def neighbours(vectors: DataFrame, k: int = NEIGHBOURS, probes: int | None = None, cells: int | None = None) -> DataFrame:
    """(id, near) from (id, v): about the k most similar others, the most similar first, by an inverted file.

    Every row is indexed, in the cell of its nearest centre, and asks the ``probes`` cells nearest to it (by default as many as
    `needed_probes` tells: few where vectors lie in clusters, many where they don't); only rows of these are compared. Rows lie in blocks in
    the order of their cells, so a cell with a third of all rows is many blocks, and blocks meet where one asks for a cell that the other has. With as many probes as cells the result is exact. Centres (at most `CELLS`) go to the tasks with the function.
    """
    own = stored(vectors.where("id IS NOT NULL AND v IS NOT NULL").select(F.col("id").cast("long").alias("id"), "v"))
    centres = fitted_cells(own, cells)
    asked = min(probes or (needed_probes(own, centres, k) if len(centres) > 1 else 1), len(centres))

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                near, asks = _nearest(_unit(np.stack(f.v.to_list()).astype(np.float64)), centres, asked), np.zeros((len(f), len(centres)), np.uint8)
                np.put_along_axis(asks, near, 1, axis=1)
                yield f.assign(home=near[:, 0].astype(np.int32), asks=[x.tobytes() for x in np.packbits(asks, axis=1)])

    placed = own.mapInPandas(assign, f"id long, v {own.schema['v'].dataType.simpleString()}, home int, asks binary")
    ordered = placed.repartitionByRange(max(1, -(-own.count() // (8 * BLOCK))), "home", "id").sortWithinPartitions("home", "id")
    return nearest_of_blocks(stored(packed(ordered, len(centres))), k)


def recall(approximate: DataFrame, exact: DataFrame) -> float:
    """The share of exact neighbours (id, near) that the approximate ones hold."""
    ids = lambda c: F.transform(c, lambda x: x["other"])
    met = exact.select("id", ids("near").alias("want")).join(approximate.select("id", ids("near").alias("got")), "id", "left")
    hits = F.size(F.array_intersect("want", F.coalesce("got", F.array().cast("array<bigint>"))))
    r = met.agg(F.sum(hits), F.sum(F.size("want"))).first()
    return 1.0 if not r[1] else r[0] / r[1]


class WordPiece:
    """Greedy longest-match pieces of normalised words from a vocabulary."""

    LONGEST = 100

    def __init__(self, vocabulary: dict[str, int]) -> None:
        self.ids = vocabulary

    @staticmethod
    def words(text: str) -> list[str]:
        spaced = "".join(f" {c} " if "一" <= c <= "鿿" or "㐀" <= c <= "䶿" else " " if c in "\t\n\r" else "" if unicodedata.category(c)[0] == "C" else c for c in text)
        plain = "".join(c for c in unicodedata.normalize("NFD", spaced) if unicodedata.category(c) != "Mn").lower()
        out = [""]
        for c in plain:
            if c.isspace():
                out.append("")
            elif unicodedata.category(c)[0] == "P" or c in "$+<=>^`|~":
                out += [c, ""]
            else:
                out[-1] += c
        return [w for w in out if w]

    def pieces(self, word: str) -> list[int]:
        unknown = [self.ids["[UNK]"]]
        if len(word) > self.LONGEST:
            return unknown
        out, at = [], 0
        while at < len(word):
            end = len(word)
            while end > at and (piece := ("##" if at else "") + word[at:end]) not in self.ids:
                end -= 1
            if end == at:
                return unknown
            out.append(self.ids[piece])
            at = end
        return out

    def encode(self, text: str | None, most: int | None = None) -> list[int]:
        ids = [self.ids["[CLS]"], *(i for w in self.words(text or "") for i in self.pieces(w)), self.ids["[SEP]"]]
        return ids[:most] if most else ids


def vocabulary(content: str) -> dict[str, int]:
    """Token ids by line number of a vocabulary file; the first of equal lines wins."""
    out: dict[str, int] = {}
    for i, line in enumerate(content.splitlines()):
        out.setdefault(line.rstrip("\r"), i)
    return out


def wordpiece(rows: DataFrame, text: str, key: str, vocabulary: dict[str, int], most: int = 128) -> DataFrame:
    """(key, ids): word-piece ids of each text, cut off after ``most``."""

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = WordPiece(vocabulary)
        for f in frames:
            yield pd.DataFrame({key: f[key], "ids": [tokenizer.encode(t, most) for t in f[text]]})

    return rows.select(key, text).mapInPandas(encode, f"{key} {rows.schema[key].dataType.simpleString()}, ids array<int>")
