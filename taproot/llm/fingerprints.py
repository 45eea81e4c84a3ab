"""Document fingerprints: a Merkle tree over paragraphs and sections.

A paragraph ends with a line break and a section with a blank line, so the paragraphs put together are the text. A
paragraph's node is the SHA-256 of its text, a section's that of its paragraphs' nodes, the root's that of its
sections' nodes: equal roots mean equal texts, and where roots differ, `differing` aligns equal nodes and names those
that were added or removed. Under a paragraph hang codes of 24 bits for its pieces: a piece ends after a word that ends
with certain letters (or after eight words), so that an edit changes the pieces around it only. The likeness of two
trees is the Dice share of the codes that both have, 1 for equal roots and less for all others.

A fingerprint is the string ``<root>;<sections>``: sections parted by ``/``, in each its paragraphs parted by ``.``,
each 16 digits of the node and then six digits per code.

All is done by SQL functions. Null texts count as empty; an empty text has one empty section; very long ones are read
whole. Repeated rows have equal fingerprints. Ties of doc_id go by the text's hash, null ids come last. An empty table
gives an empty table; other columns, whatever their names, are ignored by `edited` and kept by `fingerprints`.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taproot.llm import common
from taproot.llm.decontaminate import let

#: Runs of consecutive documents per partition, about.
RUNS = 8
_PIECE = r"\s*(?:\S{1,32}\s+){0,7}?\S{0,31}[dglmnrtyйся](?!\S)|(?:\s*\S{1,32}){1,8}|\s+"


def tree(text: Column) -> Column:
    """sections: array of arrays of (node, codes) per paragraph."""
    paragraph = lambda p: F.struct(
        F.sha2(p.cast("binary"), 256).alias("node"),
        F.transform(F.regexp_extract_all(p, F.lit(_PIECE), 0), lambda x: F.xxhash64(x).bitwiseAND(0xFFFFFF).cast("int")).alias("codes"),
    )
    return F.transform(F.split(text, r"(?<=\n\n)"), lambda s: F.transform(F.split(s, r"(?<=\n)"), paragraph))


def root_of(sections: Column) -> Column:
    section = lambda s: F.sha2(F.array_join(F.transform(s, lambda p: p["node"]), ".").cast("binary"), 256)
    return F.sha2(F.array_join(F.transform(sections, section), "/").cast("binary"), 256)


def codes_of(sections: Column) -> Column:
    """The distinct codes of a tree."""
    return F.array_distinct(F.flatten(F.transform(sections, lambda s: F.flatten(F.transform(s, lambda p: p["codes"])))))


def written(root: Column, sections: Column) -> Column:
    six = lambda c: F.substring(F.hex((c + (1 << 24)).cast("long")), 2, 6)
    paragraph = lambda p: F.concat(F.substring(p["node"], 1, 16), F.array_join(F.transform(p["codes"], six), ""))
    return F.concat(root, F.lit(";"), F.array_join(F.transform(sections, lambda s: F.array_join(F.transform(s, paragraph), ".")), "/"))


def likeness(root_a: Column, codes_a: Column, root_b: Column, codes_b: Column) -> Column:
    total = F.size(codes_a) + F.size(codes_b)
    dice = 2.0 * F.size(F.array_intersect(codes_a, codes_b)) / F.greatest(total, F.lit(1))
    return F.when(root_a == root_b, 1.0).otherwise(F.least(dice, 1.0 - 1.0 / (1.0 + total)))


def differing(sections_a: str, sections_b: str) -> Column:
    """Of two columns of trees, by name: (section, paragraph, change) of the paragraphs that the first tree has and the second hasn't ("removed", counted in
    the first) and the other way round ("added", counted in the second), in the order of an alignment of equal nodes.

    What both begin and end with is set aside; the rest is aligned by a longest common subsequence, in time of the
    product of its lengths.
    """
    leaves = "flatten(transform({}, (s, i) -> transform(s, (p, j) -> struct(i AS section, j AS paragraph, p.node AS node))))"
    none = "cast(array() as array<int>)"
    upto = lambda n: f"if({n} < 1, {none}, sequence(0, greatest({n} - 1, 0)))"
    down = lambda n: f"if({n} < 1, {none}, sequence(greatest({n} - 1, 0), 0, -1))"
    alike = lambda x, y: f"coalesce(nullif(array_position(transform({upto(f'least(size({x}), size({y}))')}, i -> {x}[i].node <> {y}[i].node), true), 0) - 1, least(size({x}), size({y})))"
    cut = lambda x, n: f"slice({x}, {n} + 1, size({x}))"
    row = f"aggregate({down('size(b)')}, array(0), (r, j) -> concat(array(if(a[i].node = b[j].node, rows[0][j + 1] + 1, greatest(rows[0][j], r[0]))), r))"
    table = f"aggregate({down('size(a)')}, array(array_repeat(0, size(b) + 1)), (rows, i) -> concat(array({row}), rows))"
    change = lambda x, i, word: f"struct({x}[{i}].section AS section, {x}[{i}].paragraph AS paragraph, '{word}' AS change)"
    step = (
        "CASE WHEN s.i < size(a) AND s.j < size(b) AND a[s.i].node = b[s.j].node THEN struct(s.i + 1 AS i, s.j + 1 AS j, s.found AS found) "
        f"WHEN s.i < size(a) AND (s.j >= size(b) OR l[s.i + 1][s.j] >= l[s.i][s.j + 1]) THEN struct(s.i + 1 AS i, s.j AS j, concat(s.found, array({change('a', 's.i', 'removed')})) AS found) "
        f"WHEN s.j < size(b) THEN struct(s.i AS i, s.j + 1 AS j, concat(s.found, array({change('b', 's.j', 'added')})) AS found) ELSE s END"
    )
    start = "struct(0 AS i, 0 AS j, cast(array() as array<struct<section: int, paragraph: int, change: string>>) AS found)"
    walk = f"aggregate({upto('size(a) + size(b)')}, {start}, (s, k) -> {step}).found"
    middle = let("n", alike("a0", "b0"), let("a1", cut("a0", "n"), let("b1", cut("b0", "n"), let("m", alike("reverse(a1)", "reverse(b1)"), let("a", "slice(a1, 1, size(a1) - m)", let("b", "slice(b1, 1, size(b1) - m)", let("l", table, walk)))))))
    return F.expr(let("a0", leaves.format(sections_a), let("b0", leaves.format(sections_b), middle)))


def fingerprints(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the columns sections, root, codes and fingerprint (behind ``prefix``) of a text column."""
    p = prefix
    made = docs.withColumn(f"{p}sections", tree(F.coalesce(F.col(text), F.lit(""))))
    made = made.withColumn(f"{p}root", root_of(F.col(f"{p}sections"))).withColumn(f"{p}codes", codes_of(F.col(f"{p}sections")))
    return made.withColumn(f"{p}fingerprint", written(F.col(f"{p}root"), F.col(f"{p}sections")))


def _bounds(docs: DataFrame) -> tuple[list[int], dict[int, int]]:
    """(ascending bounds of runs of about as many documents, {run: parts} of runs that are a single, frequent doc_id).

    Run k has the ids from bound k - 1 on and below bound k; run -1 has the null ids. A few values per partition reach the driver.
    """
    n = RUNS * common.partitions(docs)
    sizes = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("known"), F.expr(f"percentile_approx(doc_id, array({','.join(str((i + 1) / (n + 1)) for i in range(n))}), {20 * n + 10_000})").alias("q")).first()
    often = Counter(sizes["q"] or [])
    frequent = {v: k for v, k in often.items() if k > 1}
    bounds = sorted({*often, *(v + 1 for v in frequent if v < 2**63 - 1)})
    parts = {bounds.index(v) + 1: k for v, k in frequent.items()}
    return bounds, parts | {-1: -(-n * (sizes["n"] - sizes["known"]) // max(sizes["n"], 1))}


def _run(bounds: list[int]) -> str:
    """SQL: how many bounds are at most doc_id (-1 for null), by a search in three steps."""
    literal = lambda xs: f"cast(split('{','.join(map(str, xs))}', ',') as array<bigint>)" if xs else "cast(array() as array<bigint>)"
    width = max(2, math.ceil(len(bounds) ** (1 / 3)))
    found = "0"
    for step in (width * width, width, 1):
        level = bounds[step - 1 :: step]
        found = f"{found} + {step} * size(filter(slice({literal(level)}, ({found}) div {step} + 1, {width + 1}), b -> b <= doc_id))"
    return f"if(doc_id IS NULL, -1, {found})"


def followed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, run, sub, ghost): documents in descending doc_id order, dealt by runs of ids, and ghosts.

    Runs come from the ids' quantiles, so they are even however the ids are spread; an id (or null) that fills several
    is dealt by its texts' hashes. Each run also gets the first row of the run after it (a ghost), so a window over the
    run sees every row's successor, and the texts are shuffled once. The last run is followed by the first.
    """
    bounds, parts = _bounds(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    hot = {r: k for r, k in parts.items() if k > 1}
    split = "".join(f" WHEN {r} THEN {k}" for r, k in hot.items())
    sub = f"cast(least((xxhash64(text) / 18446744073709551616D + 0.5D) * (CASE run{split} END), (CASE run{split} END) - 1) as int)" if hot else "0"
    keyed = rows.withColumn("run", F.expr(_run(bounds))).withColumn("sub", F.coalesce(F.expr(sub), F.lit(0)))
    first = F.max(F.struct(F.col("doc_id").alias("head"), "h")).alias("m")
    heads = [tuple(r) for r in keyed.selectExpr("run", "sub", "doc_id", "~xxhash64(text) AS h").groupBy("run", "sub").agg(first).select("run", "sub", "m.*").collect()]  # a row per run
    order = sorted((x[:2] for x in heads), key=lambda x: (-x[0], x[1]))
    next_to = [(*x, *y) for x, y in zip(order, order[1:] + order[:1], strict=True)]
    after = common.local_table(docs.sparkSession, next_to, run=pa.int32(), sub=pa.int32(), next_run=pa.int32(), next_sub=pa.int32())
    h = F.broadcast(common.local_table(docs.sparkSession, heads, run=pa.int32(), sub=pa.int32(), head=pa.int64(), h=pa.int64()))
    texts = keyed.join(h, ["run", "sub"]).where("doc_id <=> head AND ~xxhash64(text) = h").select("run", "sub", "doc_id", "text").dropDuplicates(["run", "sub"])
    ghosts = F.broadcast(after).join(texts.withColumnsRenamed({"run": "next_run", "sub": "next_sub"}), ["next_run", "next_sub"]).select("run", "sub", "doc_id", "text", F.lit(1).alias("ghost"))
    both = keyed.select("run", "sub", "doc_id", "text", F.lit(0).alias("ghost")).unionByName(ghosts)
    return both.repartition(common.partitions(docs), "run", "sub")


def edited(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, the edited text's SHA-256, both fingerprints, near_edited and near_next.

    The edited text is the text with its last third replaced by the first as many characters of the next document.
    """
    own = fingerprints(followed(docs))
    order = "OVER (PARTITION BY run, sub ORDER BY ghost, doc_id DESC NULLS LAST, xxhash64(text))"
    own = own.selectExpr("doc_id", "text", "ghost", "root", "codes", "fingerprint", f"lead(text) {order} AS next_text", f"lead(root) {order} AS next_root", f"lead(codes) {order} AS next_codes").where("ghost = 0")
    cut = F.floor(F.length("text") / 3).cast("int")
    own = own.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - cut), F.substring("next_text", F.lit(1), cut)))
    both = fingerprints(own, "edited", "edited_")
    return both.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("root"), F.col("codes"), F.col("edited_root"), F.col("edited_codes")).alias("near_edited"),
        likeness(F.col("root"), F.col("codes"), F.col("next_root"), F.col("next_codes")).alias("near_next"),
    )


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(common.table(spark, sf_dir, "documents"))
