"""Jaccard self-join on word n-grams: MinHash banding finds candidates, full n-gram sets verify them.

1. Every text gets MinHash values of its five-word shingles; `BANDS` bands of `ROWS` values each are shuffled on their
   hashes. At similarity s two texts meet with probability 1 - (1 - s^ROWS)^BANDS: 0.9998 at 0.8.
2. Texts that meet form candidate components (links to the least text of a band's group, never pairs).
3. Each component is cut into blocks of about `BLOCK` texts or `BLOCK_SHINGLES` shingles; a text goes to the pairs of its
   block with those blocks that hold a text of one of its bands, and every pair of blocks is one group of rows, in which
   the exact similarities are computed from the full sets as one matrix product. So no pair becomes a row, texts are
   compared only where blocks share a band, a component of any size is spread over many tasks, and no link between
   texts that share a band is lost there.

Equal texts are one class, the node of all joins. The result has a row per document: doc_id, class_id (least doc_id of
all documents that links connect), copy_of (least doc_id of the equal texts) and n_links (the other documents at or
above the threshold, copies included).

Null texts count as empty. Empty texts are copies of each other and link to nothing else. A text of one to four words
is one shingle of all its words; very long texts are taken whole. Rows without a doc_id get null class_id and copy_of and
no links. Repeated rows count as copies; different texts under one doc_id are different nodes. A similarity of exactly
the threshold (a tie) links. An empty table gives an empty table; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taproot.llm import common
from taproot.llm.components import components
from taproot.llm.wordhash import U64, Words, mix

N, THRESHOLD = 5, 0.8
BANDS, ROWS = 16, 4
BLOCK, BLOCK_SHINGLES = 512, 300_000
#: Texts that are hashed at once have so many characters, about.
GROUP = 2_000_000
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=U64))
_FACTORS = mix(_SEEDS + U64(77)) | U64(1)


def groups(ids: list, texts: list) -> Iterator[tuple[list, list]]:
    """Slices of about GROUP characters."""
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= GROUP:
            yield ids[first : i + 1], texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield ids[first:], texts[first:]


def shingles(texts: list, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all n-word shingles, how many each text has). Fewer words than n are one shingle of all of them."""
    w = Words(texts)
    counts = np.where(w.lengths >= n, w.lengths - n + 1, (w.lengths > 0).astype(np.int64))
    at = np.flatnonzero((w.left >= n) | (w.place == 0))
    codes = np.empty(len(at), U64)
    whole = w.left[at] >= n
    codes[whole] = w.windows(at[whole], n)
    for i in np.flatnonzero(~whole).tolist():
        codes[i] = w.windows(at[i : i + 1], int(w.left[at[i]]))[0]
    return codes, counts


def bands(codes: np.ndarray, counts: np.ndarray, n: int = BANDS) -> np.ndarray:
    """A row of the first ``n`` band hashes per text, as signed; texts without shingles get zeros."""
    full = counts > 0
    firsts = (np.cumsum(counts) - counts)[full]
    out = np.zeros((len(counts), n), np.int64)
    if not len(firsts):
        return out
    for band in range(n):
        h = np.full(len(firsts), band + 1, U64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            h = mix(h ^ np.minimum.reduceat((codes ^ _SEEDS[k]) * _FACTORS[k], firsts))
        out[full, band] = h.view(np.int64)
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, x, text_key, n, b0..): two hashes of the text, the second of 128 bits, how many shingles it has, its band hashes."""
    names = ["doc_id", "x", "text_key", "n", *(f"b{i}" for i in range(BANDS))]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in groups(list(range(b.num_rows)), b.column(2).to_pylist()):
                codes, counts = shingles(texts)
                found = bands(codes, counts)
                keys = [xxhash.xxh3_128_digest(t or "") for t in texts]
                own = b.slice(at[0], len(at))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(keys, pa.binary()), pa.array(counts), *(pa.array(np.ascontiguousarray(c)) for c in found.T)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("x"), "text")
    return rows.mapInArrow(common.sparing(sign), "doc_id long, x long, text_key binary, n long, " + ", ".join(f"b{i} long" for i in range(BANDS)))


def linked(sets: list[np.ndarray], first: int, threshold: float) -> np.ndarray:
    """A matrix of which of the first texts link to which of the rest (to each other, if ``first`` is all)."""
    sizes = np.array([len(s) for s in sets], np.float32)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, often = np.unique(flat, return_inverse=True, return_counts=True)
    column = column.reshape(-1)
    keep = often[column] > 1
    order = np.argsort(column[keep], kind="stable")
    owner, column = owner[keep][order], np.unique(column[keep][order], return_inverse=True)[1].reshape(-1)
    a, b = slice(0, first), slice(0, None) if first == len(sets) else slice(first, None)
    common_ = np.zeros((first, len(sets) if first == len(sets) else len(sets) - first), np.float32)
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        lo, hi = np.searchsorted(column, (c, c + 4096))
        x = np.zeros((len(sets), min(4096, int(column[-1]) + 1 - c)), np.float32)
        x[owner[lo:hi], column[lo:hi] - c] = 1
        common_ += x[a] @ x[b].T
    union = sizes[a][:, None] + sizes[b][None, :] - common_
    # in whole numbers, so that a similarity of exactly the threshold counts
    return np.round(common_ * 1_000_000) >= np.round(union * threshold * 1_000_000)


def roots(link: np.ndarray, first: int, square: bool, ids: np.ndarray) -> np.ndarray:
    """The least id that each text of one group is connected to within the group."""
    label = ids.copy()
    while True:
        if square:
            new = np.minimum(label, np.where(link, label[None, :], np.iinfo(np.int64).max).min(1))
        else:
            left, right = label[:first], label[first:]
            left = np.minimum(left, np.where(link, right[None, :], np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max))
            right = np.minimum(right, np.where(link, left[:, None], np.iinfo(np.int64).max).min(0, initial=np.iinfo(np.int64).max))
            new = np.concatenate([left, right])
        if (new == label).all():
            return label
        label = new


def verified(candidates: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """(node, links, root) per text and block pair, from candidates (node, copy_of, x, weight, component, block, others)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            for rows, texts in groups(list(range(b.num_rows)), b.column(at).to_pylist()):
                codes, counts = shingles(texts)
                parts = [np.unique(c).tobytes() for c in np.split(codes, np.cumsum(counts)[:-1])]
                own = b.slice(rows[0], len(rows))
                yield pa.RecordBatch.from_arrays([*(own.column(i) for i in range(b.num_columns) if i != at), pa.array(parts, pa.binary())], names=[*(n for n in b.schema.names if n != "text"), "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("copy_of"), "text", F.xxhash64("text").alias("x")).where("copy_of IS NOT NULL")
    own = candidates.join(texts, ["copy_of", "x"]).select("node", "weight", "component", "block", "others", "text")
    own = own.mapInArrow(common.sparing(sets), "node long, weight long, component long, block int, others array<int>, shingles binary").withColumn("other", F.explode("others"))
    own = own.select("node", "weight", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "shingles")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(n).to_pylist() for n in ("component", "i", "j", "block", "node", "weight", "shingles")), strict=True))
        out: list[tuple] = []
        for (_, i, j), group in groupby(rows, key=lambda r: r[:3]):
            own = list({r[4]: r for r in group}.values())  # a repeated row is there once
            first = len(own) if i == j else sum(r[3] == i for r in own)
            if len(own) < 2 or i != j and not 0 < first < len(own):
                continue
            if i != j:
                own.sort(key=lambda r: r[3] != i)
            ids, weights = np.array([r[4] for r in own]), np.array([r[5] for r in own])
            link = linked([np.frombuffer(r[6], U64) for r in own], first, threshold)
            if i == j:
                np.fill_diagonal(link, False)
                links = link @ weights
            else:
                links = np.concatenate([link @ weights[first:], link.T @ weights[:first]])
            if links.any():
                root = roots(link, first, i == j, ids)
                out += [r for r in zip(ids.tolist(), links.tolist(), root.tolist(), strict=True) if r[1]]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["node", "links", "root"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["node", "links", "root"])

    dealt = own.repartition(common.partitions(docs), "component", "i", "j").sortWithinPartitions("component", "i", "j")
    return dealt.mapInArrow(common.sparing(check), "node long, links long, root long")


def placed(near: DataFrame, classes: DataFrame, met: DataFrame) -> DataFrame:
    """(node, component, block, others): each candidate's block, and the blocks that hold a text of one of its bands."""
    sized = near.join(classes.select("node", "n"), "node")
    needed = sized.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")).where("blocks > 1")
    # Only components of several blocks are looked up; all others have one.
    large = common.stored_small(needed)
    one = near.join(large.select("component"), "component", "left_anti").select("node", "component", F.lit(0).alias("block"), F.array(F.lit(0)).alias("others"))
    own = common.stored(near.join(large, "component").select("node", "component", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")))
    of_band = own.join(met, "node")
    held = of_band.groupBy("band").agg(F.collect_set("block").alias("held"))  # block numbers, not texts
    others = of_band.join(held, "band").groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("held"))).alias("others"))  # of a text's few bands
    return one.unionByName(own.join(others, "node"))


def ngram_join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return joined_rows(docs, threshold).select("doc_id", "class_id", "copy_of", "n_links")


def joined_rows(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, x, class_node, class_id, copy_of, n_links): `ngram_join` with each row's hash of the text and what names its class."""
    rows = docs.select("doc_id", "text")
    signed = common.stored(signatures(rows))
    alike = signed.where("doc_id IS NOT NULL").groupBy("text_key").agg(F.min("doc_id").alias("copy_of"), F.min("x").alias("x"), F.count("*").alias("weight"), F.max("n").alias("n"), *(F.min(f"b{i}").alias(f"b{i}") for i in range(BANDS)))
    classes = common.stored(alike.withColumn("node", F.monotonically_increasing_id()))
    met = classes.where("n > 0").select("node", F.explode(F.array(*(f"b{i}" for i in range(BANDS)))).alias("band"))
    hubs = met.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("k")).where("k > 1").select("band", "hub")
    near = common.stored(components(met.join(hubs, "band").select(F.col("node").alias("a"), F.col("hub").alias("b")).where("a <> b")).select("node", "component"))
    candidates = placed(near, classes, met).join(classes.select("node", "copy_of", "x", "weight"), "node")
    found = common.stored(verified(candidates, rows, threshold))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    least = joined.join(classes.select("node", "copy_of"), "node").groupBy("component").agg(F.min("copy_of").alias("class_id"))
    joined = joined.join(least, "component").select("node", "component", "class_id")
    named = classes.select("text_key", "node", "weight", "copy_of").join(links, "node", "left").join(joined, "node", "left")
    n_links = (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")
    named = named.select("text_key", F.coalesce("component", "node").alias("class_node"), F.coalesce("class_id", "copy_of").alias("class_id"), "copy_of", n_links)
    known = signed.where("doc_id IS NOT NULL").select("doc_id", "x", "text_key").join(named, "text_key").drop("text_key")
    null = lambda name: F.lit(None).cast("long").alias(name)
    none = signed.where("doc_id IS NULL").select("doc_id", "x", null("class_node"), null("class_id"), null("copy_of"), F.lit(0).cast("long").alias("n_links"))
    return known.unionByName(none)


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each group of linked ones (the least doc_id, then the least hash of its text), with the columns that it had.

    Of repeated rows one stays; rows without a doc_id stay.
    """
    found = common.stored(joined_rows(docs, threshold).where("doc_id IS NOT NULL").select("class_node", F.struct("doc_id", "x").alias("row")))
    first = found.groupBy("class_node").agg(F.min("row").alias("first"), F.count("*").alias("k")).where("k > 1")
    grouped = found.join(common.stored_small(first.select("class_node", "first")), "class_node")
    names = lambda df, kind: df.select(F.col("row.doc_id").alias(f"{kind}_id"), F.col("row.x").alias(f"{kind}_x"))
    gone = common.stored_small(names(grouped.where("row <> first"), "_gone").distinct())
    same = lambda df, other, kind: (df["doc_id"] == other[f"{kind}_id"]) & (F.xxhash64(df["text"]) == other[f"{kind}_x"])
    kept = docs.join(gone, same(docs, gone, "_gone"), "left_anti")
    stored = common.Counted(names(grouped.where("row = first").groupBy("row").count().where("count > 1"), "_twice"))
    if not stored.rows:
        return kept
    twice = F.broadcast(stored.read()) if stored.rows <= common.BROADCAST_ROWS else stored.read()
    once = kept.join(twice, same(kept, twice, "_twice"), "left_anti")
    return once.unionByName(kept.join(twice, same(kept, twice, "_twice"), "left_semi").dropDuplicates(["doc_id", "text"]))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(common.table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, text, list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i : i + 4], ' ')) END) AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 5 * c >= 4 * (na + nb - c) UNION SELECT x.doc_id, y.doc_id FROM s x JOIN s y ON x.text = y.text AND x.doc_id <> y.doc_id),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT s.doc_id, (SELECT min(b) FROM r WHERE r.a = s.doc_id) AS class_id, min(s.doc_id) OVER (PARTITION BY s.text) AS copy_of, (SELECT count(*) FROM l WHERE l.a = s.doc_id) AS n_links FROM s
"""
