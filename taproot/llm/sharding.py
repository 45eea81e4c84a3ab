"""Shards by balanced label propagation: linked documents meet in one shard, and the shards stay even.

A node is a text, weighed by the documents that have it, so equal texts move as one. Nodes are linked through hubs: the
MinHash bands of their five-word shingles that near copies share, so a group of any size costs a few links per text.
Every node starts with a label by hash. Each round joins the labels with the links: a hub takes the label that most
of its members have, and members want to move there. What wants to move from shard to shard is summed up (one row
per pair of shards), and quotas by pair admit as much as keeps every shard within `SLACK` of the mean; who is admitted
goes by the hub's hash, so groups move as wholes where they can. Rounds end when nobody wants to move, or when a round no
longer lowers the number of cut links (`cut_links`).

The law `rows` then holds exactly: documents are ranked by (label, group of near copies, text, doc_id) and cut at equal
counts, which splits a text's documents at a cut only; those of a text larger than a shard span several.

Null texts count as empty; empty texts have no links; very long ones are hashed whole. Ties of votes go by a hash of the
round. Null doc_ids come first within their text; repeated rows are documents of their own. An empty table gives an
empty table; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taproot.llm import common
from taproot.llm.ngram_join import bands, groups, shingles

SHARDS, SLACK = 8, 1.25
#: MinHash bands that link near copies: two texts at similarity 0.8 share one with probability 0.88.
BANDS = 4


def quotas(flows: dict[tuple[int, int], int], sizes: dict[int, int], k: int, slack: float = SLACK) -> dict[tuple[int, int], float]:
    """Which share of each flow (from, to) may move: swaps first, then what fits below the slack."""
    cap = slack * sum(sizes.values()) / k
    share = {}
    for (a, b), n in flows.items():
        swap = min(n, flows.get((b, a), 0))
        share[a, b] = swap
    for b in range(k):
        room = cap - sizes.get(b, 0) - sum(share[x] for x in share if x[1] == b) + sum(share[x] for x in share if x[0] == b)
        want = {x: flows[x] - share[x] for x in flows if x[1] == b and flows[x] > share[x]}
        total = sum(want.values())
        for x, n in want.items():
            share[x] += n * min(1.0, max(0.0, room) / total)
    return {x: share[x] / flows[x] for x in flows}


def links_of(docs: DataFrame) -> DataFrame:
    """(node, hub) of (node, text): the bands that several nodes have."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in groups(list(range(b.num_rows)), b.column(1).to_pylist()):
                codes, counts = shingles(texts)
                own, has = b.column(0).slice(at[0], len(at)).to_numpy(), counts > 0
                found = bands(codes, counts, BANDS)[has]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own[has], BANDS)), pa.array(found.reshape(-1))], names=["node", "hub"])

    own = common.stored(docs.select("node", "text").mapInArrow(sign, "node long, hub long").distinct())
    met = own.groupBy("hub").agg(F.count("*").alias("n")).where("n > 1")
    return common.joined_by_hub(own, common.stored(met), "hub", "n", own.count()).select("node", "hub")


def cut_links(links: DataFrame, labels: DataFrame) -> tuple[int, int]:
    """(links, those whose node isn't in the shard where most of the hub's members are)."""
    votes = links.join(labels, "node").groupBy("hub", "label").agg(F.count("*").alias("n"))
    of_hub = votes.groupBy("hub").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    r = of_hub.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") - F.col("most")), F.lit(0))).first()
    return r[0], r[1]


def first_label(k: int):
    return F.pmod(F.xxhash64("node"), F.lit(k)).cast("int")


def propagate(nodes: DataFrame, links: DataFrame, k: int = SHARDS) -> DataFrame:
    """(node, label) of the linked ones of nodes (node, weight), by links (node, hub); all others keep `first_label`."""
    sizes = {r["label"]: r["n"] for r in nodes.groupBy(first_label(k).alias("label")).agg(F.sum("weight").alias("n")).collect()}  # k rows
    member = common.Stored(links.join(nodes, "node").select("node", "hub", "weight"))
    total = member.read().count()
    held = common.Stored(member.read().select("node", "weight").distinct().withColumn("label", first_label(k)))
    if not total:
        return held.read().select("node", "label")
    cut, turn = cut_links(member.read().select("node", "hub"), held.read().select("node", "label"))[1], 0
    while True:
        now = held.read()
        votes = member.read().join(now.select("node", "label"), "node").groupBy("hub", "label").agg(F.sum("weight").alias("w"), F.count("*").alias("n"))
        # Ties go by a hash of the round, so that they don't all press into one shard.
        most = F.max(F.struct("w", F.xxhash64("hub", "label", F.lit(turn)).alias("tie"), "label")).alias("m")
        best = common.stored(votes.groupBy("hub").agg(most, F.sum("n").alias("n")).select("hub", F.col("m.label").alias("to"), F.col("m.w").alias("w"), "n"))
        wish = common.joined_by_hub(member.read().select("node", "hub"), best, "hub", "n", total).groupBy("node").agg(F.max(F.struct("w", "hub", "to")).alias("m"))
        moves = now.join(wish.select("node", F.col("m.to").alias("to"), F.col("m.hub").alias("hub")), "node")
        plan = common.Stored(moves.withColumn("luck", (F.pmod(F.xxhash64("hub", F.lit(turn)), F.lit(1_000_000)) / 1_000_000.0)))
        flows = {(r["label"], r["to"]): r["n"] for r in plan.read().where("label <> to").groupBy("label", "to").agg(F.sum("weight").alias("n")).collect()}  # k * k rows
        if not flows:
            break
        admitted = quotas(flows, sizes, k)
        share = F.create_map(*(F.lit(x) for a, b in admitted for x in (a * k + b, admitted[a, b])))
        goes = F.coalesce(F.try_element_at(share, F.col("label") * k + F.col("to")), F.lit(0.0)) > F.col("luck")
        following = common.Stored(plan.read().select("node", "weight", F.when(goes, F.col("to")).otherwise(F.col("label")).alias("label"), F.col("label").alias("was")))
        plan.drop()
        left = cut_links(member.read().select("node", "hub"), following.read().select("node", "label"))[1]
        if left >= cut:
            following.drop()
            break
        moved = following.read().where("label <> was").groupBy("was", "label").agg(F.sum("weight").alias("n")).collect()  # k * k rows
        for r in moved:
            sizes[r["was"]] -= r["n"]
            sizes[r["label"]] = sizes.get(r["label"], 0) + r["n"]
        held.drop()
        held, cut, turn = following, left, turn + 1
    return held.read().select("node", "label")


def shard(docs: DataFrame, k: int = SHARDS) -> DataFrame:
    """Per row of (doc_id, text): doc_id, size, text_crc32, shard, slot, hub. Counts of shards differ by one at most.

    ``hub`` names the text.
    """
    crc = F.crc32(F.col("text").cast("binary"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("node", F.xxhash64("text", F.octet_length("text"), crc))
    own = common.stored(rows.select("doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), crc.alias("text_crc32"), "node"))
    nodes = common.stored(own.groupBy("node").agg(F.count("*").alias("weight")))
    links = common.stored(links_of(rows))
    labels = propagate(nodes, links, k).join(links.groupBy("node").agg(F.min("hub").alias("near")), "node")
    n = own.count()
    labels = common.joined_by_hub(own, common.stored(labels.join(nodes, "node").select("node", "label", "near", "weight")), "node", "weight", n)
    alone = common.stored(nodes.join(links.select("node").distinct(), "node", "left_anti"))
    alone = common.joined_by_hub(own, alone, "node", "weight", n)
    placed = labels.select(*own.columns, "label", "near").unionByName(alone.select(*own.columns, first_label(k).alias("label"), F.col("node").alias("near")))
    ranked = common.ranked(placed, [F.col("label"), F.col("near"), F.col("node"), F.col("doc_id")], parts=common.partitions(own))
    # The first n % k shards hold one document more.
    small, more = divmod(n, k)
    big = more * (small + 1)
    r = F.col("rank")
    found = ranked.withColumn("shard", (F.when(r < big, F.floor(r / F.lit(small + 1))).otherwise(more + F.floor((r - big) / F.lit(max(small, 1))))).cast("int"))
    first = F.when(F.col("shard") < more, F.col("shard") * (small + 1)).otherwise(big + (F.col("shard") - more) * small)
    return found.withColumn("slot", (r - first).cast("long")).select("doc_id", "size", "text_crc32", "shard", "slot", F.col("node").alias("hub"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
