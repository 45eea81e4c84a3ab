"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, and exact weighted similarity.

1. Each text is lowered and cut into words. A Bloom filter of the benchmark's five-word shingles (of bounded size)
   tells within the row which positions may hold one; a join of their hashes with the benchmark's tells which do. A
   window is kept if it begins and ends where runs of items' shingles do, wherever in the item these lie, and has as
   many of them as the weights below ask for. It has no more words than the longest item and what the threshold lets
   come on top. Texts are not shuffled, only the hashes of those with hits.
2. Different windows only (a passage in a third of all documents counts once) get a 64-bit SimHash of their weighted
   shingles, as every item does.
3. Fingerprints are cut into four blocks of 16 bits. Two within `RADIUS` bits differ by at most RADIUS // 4 bits in
   some block; items are indexed with up to two flips per block and windows look up up to one, so all such pairs meet.
4. The exact similarity decides: common weight of distinct shingles over the weight of all, at `THRESHOLD` or more. A
   shingle weighs 1 + 1 / (number of items that have it), or 2 if none has.

All is done by SQL functions. Null texts count as empty. Items of fewer than five words and null items are ignored; with no
item left nothing matches. Repeated rows of a document give one row. Null doc_ids are matched as one document. An
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from taproot.llm import common

N, THRESHOLD, RADIUS, BLOCKS = 5, 0.8, 15, 4
#: Bits of the Bloom filter: so many per shingle, within these bounds. A full filter only sends more positions to the join.
BITS_EACH, BITS_MIN, BITS_MAX = 160, 1 << 12, 1 << 22
_WORDS = r"split(regexp_replace(lower(coalesce({}, '')), r'^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$', ''), r'[\x09-\x0D\x20]+')"
_NONE = "cast(array() as array<bigint>)"


def let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, which is then computed once per row wherever it is used."""
    return f"transform(array({value}), {name} -> {body})[0]"


def shingle_hashes(w: str) -> str:
    """Hashes of all five-word shingles of an array; none below five words."""
    return f"if(size({w}) < {N}, {_NONE}, transform(sequence(1, greatest(size({w}) - {N - 1}, 1)), i -> xxhash64(slice({w}, i, {N}))))"


class Bloom:
    """Two bits per hash in an array of longs that becomes a literal."""

    def __init__(self, hashes: DataFrame, count: int) -> None:
        """hashes: a column h of ``count`` different longs."""
        self.bits = BITS_MIN
        while self.bits < min(BITS_MAX, BITS_EACH * count):
            self.bits *= 2
        held = [0] * (self.bits // 64)
        both = hashes.select(F.explode(F.array(F.expr(self._bit("h", 0)), F.expr(self._bit("h", 1)))).alias("bit"))
        for r in both.groupBy(F.expr("cast(bit div 64 as int)").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("v")).collect():  # at most BITS_MAX / 64 rows
            held[r["at"]] = r["v"]
        self.literal = f"cast(split('{','.join(map(str, held))}', ',') as array<bigint>)"

    def _bit(self, h: str, k: int) -> str:
        return f"(shiftrightunsigned({h}, {24 * k}) & {self.bits - 1}L)"

    def has(self, name: str, h: str) -> str:
        """SQL: whether ``h`` may be in the filter whose literal is bound to ``name``."""
        test = lambda k: f"getbit({name}[cast(shiftright({self._bit(h, k)}, 6) as int)], cast({self._bit(h, k)} & 63L as int)) = 1"
        return f"({test(0)} AND {test(1)})"


def item_shingles(items: DataFrame) -> DataFrame:
    """(item_id, n, h): the shingles of each item as often as they occur, n words."""
    own = items.select("item_id", F.explode(F.array(F.expr(_WORDS.format("text")))).alias("w"))
    return own.select("item_id", F.size("w").alias("n"), F.explode(F.expr(shingle_hashes("w"))).alias("h"))


def bounded(item_weights: DataFrame, threshold: float) -> tuple[DataFrame, int, int]:
    """``item_weights`` (item_id, h, w) stored, how many different shingles a window shares with any item at least, and
    how many it has beyond an item's at most."""
    of = Window.partitionBy("item_id")  # the shingles of one item's text
    own = item_weights.withColumn("total", F.sum("w").over(of)).withColumn("most", F.max("w").over(of))
    # A shingle weighs more than 1, and none of an item's more than its heaviest.
    shared = F.ceil(threshold * F.col("total") / F.col("most") - 1e-6)
    beyond = F.floor((1 / threshold - 1) * F.col("total") + 1e-6)
    seen = Observation()
    kept = common.stored(own.observe(seen, F.min(shared).alias("shared"), F.max(beyond).alias("beyond")).drop("total", "most"))
    return kept, int(seen.get["shared"]), int(seen.get["beyond"])


def windows(docs: DataFrame, known: DataFrame, count: int, least: int, most_long: int, threshold: float) -> DataFrame:
    """(doc_id, start, n_words, window, hashes) of the windows that may match; ``window`` names equal sets of hashes.

    known: (h, items), each of ``count`` shingles once with a hash of the set of items that have it. A window has ``least`` different
    shingles of items at least and ``most_long`` words at most.
    """
    anywhere = Bloom(known, count)
    none = "cast(array() as array<struct<h: array<bigint>, hits: array<int>>>)"
    hits = f"filter(transform(h, (x, i) -> if({anywhere.has('bloom', 'x')}, i, -1)), i -> i >= 0)"
    whole = let("w", _WORDS.format("text"), let("h", shingle_hashes("w"), let("bloom", anywhere.literal, let("hits", hits, f"if(size(hits) < {least}, {none}, array(struct(h, hits)))"))))
    # The outer array keeps the optimiser from copying the expression into a filter.
    own = docs.select("doc_id", F.explode(F.array(F.expr(whole))).alias("x")).select("doc_id", F.explode("x").alias("x"))
    rows = common.stored(own.select(F.monotonically_increasing_id().alias("row"), "doc_id", "x.h", "x.hits"))
    # What the filter lets through is looked up, so a place is a hit only if some item has its shingle.
    met = rows.select("row", F.explode(F.expr("transform(hits, i -> struct(i AS at, h[i] AS h))")).alias("x")).select("row", "x.at", "x.h").join(F.broadcast(known) if count <= common.BROADCAST_ROWS else known, "h")
    met = met.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "items"))).alias("k")).where(F.size("k") >= least)
    # The best window of an item begins where a run of its shingles begins, and ends where one ends. There the set of
    # items changes from one place to the next.
    starts = "transform(filter(sequence(0, size(k) - 1), j -> j = 0 OR k[greatest(j - 1, 0)].at < k[j].at - 1 OR k[greatest(j - 1, 0)].items <> k[j].items), j -> k[j].at)"
    ends = "transform(filter(sequence(0, size(k) - 1), j -> j = size(k) - 1 OR k[least(j + 1, size(k) - 1)].at > k[j].at + 1 OR k[least(j + 1, size(k) - 1)].items <> k[j].items), j -> k[j].at)"
    pairs = f"flatten(transform(starts, s -> transform(filter(ends, e -> e - s + {N} BETWEEN {least + N - 1} AND {most_long}), e -> struct(s AS start, e - s + {N} AS n_words, array_sort(array_distinct(slice(h, s + 1, e - s + 1))) AS hashes))))"
    # No shingle weighs more than one that no item has, so a window of too few hits can't reach the threshold.
    enough = f"filter(pairs, x -> size(array_intersect(x.hashes, held)) >= {threshold} * size(x.hashes) - 1e-6)"
    found = let("held", "transform(k, x -> h[x.at])", let("starts", starts, let("ends", ends, let("pairs", pairs, enough))))
    own = rows.select("row", "doc_id", "h").join(met, "row").select("doc_id", F.explode(F.array(F.expr(found))).alias("x")).select("doc_id", F.explode("x").alias("x"))
    return own.select("doc_id", "x.start", "x.n_words", F.xxhash64("x.hashes").alias("window"), "x.hashes")


def simhash(weighted: DataFrame, key: str, total: str) -> DataFrame:
    """(key, ``total``, fp) from (key, h, w): the sum of all weights; bit b is set if the weights of hashes with that bit are more than those without."""
    sums = weighted.groupBy(key).agg(F.sum("w").alias(total), *(F.expr(f"sum(if(getbit(h, {b}) = 1, w, -w))").alias(f"s{b}") for b in range(64)))
    return sums.select(key, total, F.expr(" | ".join(f"if(s{b} > 0, shiftleft(1L, {b}), 0L)" for b in range(64))).alias("fp"))


def _masks(flips: int) -> str:
    return ",".join(str(sum(1 << b for b in c)) for k in range(flips + 1) for c in combinations(range(64 // BLOCKS), k))


def near(queries: DataFrame, items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All (window, item_id) whose fingerprints differ in at most ``radius`` bits, by blocks, with the other columns that the two sides had."""
    flips = radius // BLOCKS
    width = 64 // BLOCKS
    keys = lambda df, n: df.selectExpr("*", f"explode(sequence(0, {BLOCKS - 1})) AS block").selectExpr("*", f"explode(array({_masks(n)})) AS mask").selectExpr("*", f"(shiftrightunsigned(fp, {width} * block) & {(1 << width) - 1}L) ^ mask AS value").drop("mask")
    left, right = keys(queries, flips // 2), keys(items.withColumnRenamed("fp", "item_fp").withColumn("fp", F.col("item_fp")), flips - flips // 2).drop("fp")
    # Spark takes an exploded side for as small as it was before, and would broadcast it by way of the driver.
    met = left.join(right.hint("merge"), ["block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    return met.select(*(c for c in (*queries.columns, *items.columns) if c != "fp")).distinct()


def matched(docs: DataFrame, benchmark: DataFrame, threshold: float) -> DataFrame | None:
    """(doc_id, item_id, start, n_words, similarity) of all windows that match; None if no item can match.

    Figures that later steps ask for are observed as tables are written, and sums are taken where rows meet anyway:
    each query, and each scan, stage and broadcast in it, costs the driver memory.
    """
    items = benchmark.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    seen = Observation()
    shingles = common.stored(item_shingles(items).observe(seen, F.max("n").alias("longest")))
    longest = seen.get.get("longest")
    if longest is None:
        return None
    of = shingles.select("item_id", "h").distinct()
    kept = common.Counted(of.groupBy("h").agg((1 + 1 / F.count("*")).alias("w"), F.bit_xor(F.xxhash64("item_id")).alias("items")))
    known = kept.read()
    weights = known.select("h", "w")
    item_weights, least, beyond = bounded(of.join(weights, "h"), threshold)
    found = common.stored(windows(docs, known.select("h", "items"), kept.rows, least, longest + beyond, threshold))
    different = found.groupBy("window").agg(F.first("hashes").alias("hashes")).select("window", F.explode("hashes").alias("h"))
    window_weights = common.stored(different.join(weights, "h", "left").withColumn("w", F.coalesce("w", F.lit(2.0))))
    pairs = near(simhash(window_weights, "window", "own"), simhash(item_weights, "item_id", "of_item"))
    both = pairs.join(window_weights, "window").join(item_weights.select("item_id", "h"), ["item_id", "h"])
    exact = both.groupBy("window", "item_id").agg(F.sum("w").alias("both"), F.first("own").alias("own"), F.first("of_item").alias("of_item"))
    exact = exact.select("window", "item_id", (F.col("both") / (F.col("own") + F.col("of_item") - F.col("both"))).alias("similarity")).where(F.col("similarity") >= threshold - 1e-9)
    return found.select("doc_id", "start", "n_words", "window").join(common.stored_small(exact), "window")


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity): each document's best window for each item at the threshold.

    ``start`` counts words from 0.
    """
    found = matched(docs, benchmark, threshold)
    if found is None:
        return docs.sparkSession.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, start int, n_words int, similarity double")
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), "n_words")).alias("m")).select("doc_id", "item_id", (-F.col("m.s")).alias("start"), "m.n_words", F.round("m.similarity", 6).alias("similarity"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that hold no item, with the columns that they had."""
    found = matched(docs, benchmark, threshold)
    if found is None:
        return docs
    hit = common.stored_small(found.select(F.col("doc_id").alias("_hit")).distinct())
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["_hit"]), "left_anti")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
