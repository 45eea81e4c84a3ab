"""Joins of facts: intervals, names, nearest lines, suppression, scopes, baselines and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taproot.storage import shuffled

#: Lines per bucket of an interval join.
BUCKET = 64


def references_in_range(declarations: DataFrame, references: DataFrame) -> DataFrame:
    """Each declaration (decl, file, first, last) with the references (ref, file, line) in its lines.

    Both sides are dealt by (file, bucket of lines), so a file with a third of all lines is spread over its buckets.
    """
    spans = declarations.withColumn("bucket", F.explode(F.sequence((F.col("first") / BUCKET).cast("int"), (F.col("last") / BUCKET).cast("int"))))
    points = references.withColumn("bucket", (F.col("line") / BUCKET).cast("int"))
    return spans.join(points, ["file", "bucket"]).where("line BETWEEN first AND last").select("decl", "ref", "file", "line")


def name_edges(declarations: DataFrame, uses: DataFrame) -> DataFrame:
    """(src, dst): uses (src, name) against every declaration (decl, name) of that name.

    Uses are distinct before the join: what fans out is at most a pair per name and user.
    """
    return uses.select("src", "name").distinct().join(declarations.select(F.col("decl").alias("dst"), "name"), "name").select("src", "dst").distinct()


def name_hops(declarations: DataFrame, uses: DataFrame) -> DataFrame:
    """(src, dst): uses (src, name) lead to a node of the name, and that to every declaration (decl, name) of it.

    What reaches what is as with `name_edges`, but a common name costs its users plus its declarations, not their product.
    A name's node starts with a character that no id of a declaration has.
    """
    node = F.concat(F.lit("\0"), F.col("name"))
    used = uses.select("src", "name").distinct().join(declarations.select("name").distinct(), "name", "left_semi")
    return used.select("src", node.alias("dst")).unionByName(declarations.select(node.alias("src"), F.col("decl").alias("dst")).distinct())


def nearest(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """Each left row (id, key, line) with the nearest right row (other, key, at) within ``most`` lines.

    Ties go to the lower line, then the lower id. Lines are bucketed by ``most`` + 1, so only neighbours meet.
    """
    size = most + 1
    l = left.withColumn("bucket", F.explode(F.array(*(F.floor(F.col("line") / size) + i for i in (-1, 0, 1)))))
    r = right.withColumn("bucket", F.floor(F.col("at") / size))
    met = l.join(r, ["key", "bucket"]).where(F.abs(F.col("line") - F.col("at")) <= most)
    best = met.groupBy("id").agg(F.min(F.struct(F.abs(F.col("line") - F.col("at")).alias("distance"), "at", "other")).alias("m"))
    return best.select("id", "m.other", "m.distance")


def suppressed_at_point(findings: DataFrame, accepts: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """Findings (…, *keys, line) that an accepting comment (*keys, line) on their line or the one before covers."""
    lines = accepts.select(*keys, F.explode(F.array(F.col("line"), F.col("line") + 1)).alias("line")).distinct()
    return findings.join(lines, [*keys, "line"], "left_semi")


def region_state(file: str | list[str], order: list[Column], toggle: Column) -> Column:
    """The last non-null toggle at or before each row of a file, in order: an as-of join without a join."""
    return F.last(toggle, ignorenulls=True).over(Window.partitionBy(*([file] if isinstance(file, str) else file)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def split_by(rows: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is there, the others). An empty key table keeps nothing; that is no missing scope."""
    return rows.join(keys, on, "left_semi"), rows.join(keys, on, "left_anti")


def unused_names(declarations: DataFrame, references: DataFrame) -> DataFrame:
    return declarations.join(references.select("name").distinct(), "name", "left_anti")


def unused_imports(imports: DataFrame, references: DataFrame) -> DataFrame:
    """Imports (file, module) that no reference (file, identifier, qualifier) of their file names either way."""
    named = references.select("file", F.explode(F.array("identifier", "qualifier")).alias("module")).where("module IS NOT NULL").distinct()
    return imports.join(named, ["file", "module"], "left_anti")


def assign_only(references: DataFrame, key: str, is_write: Column) -> DataFrame:
    """Keys that have references, all of them writes."""
    return references.groupBy(key).agg(F.bool_and(is_write).alias("writes"), F.count("*").alias("n")).where("writes").select(key, "n")


def collapsed(members: DataFrame, flagged: DataFrame) -> DataFrame:
    """Members (…, owner) whose owner isn't flagged itself."""
    return members.join(flagged.select("owner").distinct(), "owner", "left_anti")


def witnesses(requirements: DataFrame, members: DataFrame, conformances: DataFrame) -> DataFrame:
    """(requirement, member) of one name, where the member's type conforms to the requirement's protocol.

    There may be far more pairs than rows, so they aren't shuffled to be made distinct: both sides are distinct before they meet, and a
    member of one type and name then meets a requirement once. Only pairs of members with several are made distinct afterwards.
    """
    wanted = requirements.join(conformances, "protocol").select("requirement", "type", "name").distinct()
    have = members.select("member", "type", "name").where("type IS NOT NULL AND name IS NOT NULL").distinct()
    keys = have.groupBy("member").agg(F.count("*").alias("n"), F.min("type").alias("type"), F.min("name").alias("name"))
    several = shuffled(keys.where("n > 1").select(F.col("member").alias("again")))
    pairs = lambda some: wanted.join(shuffled(some), ["type", "name"]).select("requirement", "member")
    once = pairs(keys.where("n = 1").select("member", "type", "name"))
    return once.unionByName(pairs(have.join(several, F.col("member").eqNullSafe(F.col("again")), "left_semi")).distinct())


def cache_plan(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, state): hit, miss or pruned, by path and fingerprint of two snapshots."""
    o, n = old.select("path", F.col("fingerprint").alias("was")), new.select("path", F.col("fingerprint").alias("now"))
    state = F.when(F.col("now").isNull(), "pruned").when(F.col("was") == F.col("now"), "hit").otherwise("miss")
    return o.join(n, "path", "full").select("path", state.alias("state"))


def merged(cached: DataFrame, fresh: DataFrame, plan: DataFrame) -> DataFrame:
    """The next snapshot: cached rows of hits and fresh rows of misses."""
    hits, misses = (plan.where(F.col("state") == s).select("path") for s in ("hit", "miss"))
    return cached.join(hits, "path", "left_semi").unionByName(fresh.join(misses, "path", "left_semi"))
