"""Reachability by a compiler's index: symbols and occurrences as two tables.

symbols: (usr, name, kind, path, line). occurrences: (usr, path, line, role, relation, related): ``role`` is one of
definition, call, read, write, reference; ``relation`` is containedBy, baseOf, overrideOf, childOf or null, and ``related`` the
other symbol. Native index stores aren't read; any source that gives these tables will do.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taproot.functions import text
from taproot.operators import graph, relations
from taproot.storage import shuffled, stored

#: Lines that a declaration and its symbol may be apart.
NEAREST = 5


def symbol_edges(occurrences: DataFrame) -> DataFrame:
    """(src, dst, kind): containers use what they contain, bases and members lead both ways where dispatch may."""
    o = occurrences.where("related IS NOT NULL")
    uses = o.where("relation = 'containedBy' AND role <> 'definition'").select(F.col("related").alias("src"), F.col("usr").alias("dst"), F.col("role").alias("kind"))
    bases = o.where("relation = 'baseOf'").select(F.col("related").alias("src"), F.col("usr").alias("dst"), F.lit("inheritance").alias("kind"))
    overrides = o.where("relation = 'overrideOf'").select(F.col("related").alias("src"), F.col("usr").alias("dst"), F.lit("override").alias("kind"))
    members = o.where("relation = 'childOf'").select(F.col("usr").alias("src"), F.col("related").alias("dst"), F.lit("member").alias("kind"))
    return uses.unionByName(bases).unionByName(overrides).unionByName(members).dropDuplicates(["src", "dst"])


def protocol_witnesses(symbols: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(src, dst): a protocol's member to the equally named member of a type that conforms to it."""
    members = occurrences.where("relation = 'childOf'").select(F.col("usr").alias("member"), F.col("related").alias("owner")).distinct().join(shuffled(symbols.select(F.col("usr").alias("member"), "name")), "member")
    protocols = shuffled(symbols.where("kind = 'protocol'").select(F.col("usr").alias("protocol")))
    conforms = occurrences.where("relation = 'baseOf'").select(F.col("usr").alias("protocol"), F.col("related").alias("type")).distinct().join(protocols, "protocol")
    wanted = members.withColumnRenamed("owner", "protocol").join(protocols, "protocol", "left_semi").select(F.col("member").alias("requirement"), "protocol", "name")
    have = members.select("member", F.col("owner").alias("type"), "name")
    return relations.witnesses(wanted, have, conforms).select(F.col("requirement").alias("src"), F.col("member").alias("dst"))


def mapped(declarations: DataFrame, symbols: DataFrame) -> DataFrame:
    """(decl, usr): each declaration with the symbol of its file and base name on the nearest line, if near enough."""
    base = lambda c: F.regexp_extract(c, r"^([^(]*)", 1)
    key = lambda path, name: F.concat_ws("|", path, base(name))
    left = declarations.select(F.col("decl").alias("id"), key(F.col("path"), F.col("name")).alias("key"), "line")
    right = symbols.select(F.col("usr").alias("other"), key(F.col("path"), F.col("name")).alias("key"), F.col("line").alias("at"))
    return relations.nearest(left, right, NEAREST).select(F.col("id").alias("decl"), F.col("other").alias("usr"))


TYPES = ("class", "struct", "enum", "protocol", "actor", "typealias")


def forced(declarations: DataFrame) -> DataFrame:
    """(decl) of declarations that an index can't judge.

    Locals, requirements and members of protocol extensions; and, where declarations come with their conformances, types that others
    build on, and members that meet a requirement of a protocol of their type: dispatch leaves no reference by name.
    """
    protocols = declarations.where("kind = 'protocol'").select(F.col("name").alias("enclosing_type")).distinct()
    in_extension = declarations.where("enclosing_kind = 'extension'").join(protocols, "enclosing_type", "left_semi").select("decl")
    out = declarations.where("local OR enclosing_kind <=> 'protocol'").select("decl").union(in_extension)
    if "conformances" in declarations.columns:
        base = text.base_name(F.trim("one"))
        written = declarations.select(F.coalesce(F.when(F.col("kind") != "extension", F.col("name")), "enclosing_type", "name").alias("type"), F.explode("conformances").alias("all"))
        uses = written.select("type", F.explode(F.split("all", "&")).alias("one")).select("type", base.alias("base")).distinct()
        bases = declarations.where(F.col("kind").isin(*TYPES)).join(uses.select(F.col("base").alias("name")).distinct(), "name", "left_semi").select("decl")
        wanted = declarations.where("enclosing_kind = 'protocol'").select(F.col("enclosing_type").alias("protocol"), "name", F.lit(None).alias("requirement")).distinct()
        members = declarations.where("enclosing_type IS NOT NULL AND NOT enclosing_kind <=> 'protocol'").select(F.col("decl").alias("member"), F.col("enclosing_type").alias("type"), "name")
        met = relations.witnesses(wanted, members, uses.withColumnRenamed("base", "protocol")).select(F.col("member").alias("decl"))
        out = out.union(bases).union(met)
    return out.distinct()


def verdicts(declarations: DataFrame, roots: DataFrame, symbols: DataFrame, occurrences: DataFrame, syntax: DataFrame | None = None) -> DataFrame:
    """(root_set, decl, provenance) of what each root set (root_set, decl) reaches.

    Declarations with a symbol are judged by the index, from the symbols of roots and of forced declarations, which are always
    reached. Those without one are judged by ``syntax`` (root_set, decl) if it is given, else they count as reached: a gap of the
    index accuses nobody.
    """
    pairs, held = stored(mapped(declarations, symbols)), stored(forced(declarations))
    sets = roots.select("root_set").distinct()
    edges = symbol_edges(occurrences).select("src", "dst").unionByName(protocol_witnesses(symbols, occurrences))
    names = [r["root_set"] for r in sets.collect()]  # as many as the analysis has modes: one or two
    every = F.explode(F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")).alias("root_set")
    always = held.select(every, "decl")
    start = roots.select("root_set", "decl").union(always).join(pairs, "decl").select("root_set", F.col("usr").alias("node"))
    live = graph.reachable(edges, start).select("root_set", F.col("node").alias("usr")).join(pairs, "usr").select("root_set", "decl", F.lit("index").alias("provenance"))
    unmapped = declarations.select("decl").join(pairs, "decl", "left_anti").join(held, "decl", "left_anti")
    if syntax is None:
        rest = unmapped.select(every, "decl", F.lit("unmapped").alias("provenance"))
    else:
        rest = syntax.select("root_set", "decl").join(unmapped, "decl", "left_semi").select("root_set", "decl", F.lit("syntax").alias("provenance"))
    sure = always.withColumn("provenance", F.lit("forced"))
    return stored(live.join(held, "decl", "left_anti").unionByName(sure).unionByName(rest).distinct())


def stale(files: DataFrame, units: DataFrame) -> DataFrame:
    """(path) of files (path, modified) that are newer than their last unit (path, indexed), or have none; unknown times are none."""
    last = units.groupBy("path").agg(F.max("indexed").alias("indexed"))
    return files.where("modified IS NOT NULL").join(last, "path", "left").where("indexed IS NULL OR modified > indexed").select("path")


@dataclass(frozen=True)
class Index:
    """An index as tables; ``units`` (path, indexed: seconds) tells when files were indexed."""

    symbols: DataFrame
    occurrences: DataFrame
    units: DataFrame | None = None


def opened(spark: SparkSession, path: str) -> tuple[Index | None, str]:
    """The index of a folder with symbols.parquet, occurrences.parquet and maybe units.parquet, or none and the reason."""
    try:
        symbols, occurrences = (spark.read.parquet(f"{path}/{name}.parquet") for name in ("symbols", "occurrences"))
        if missing := {"usr", "name", "kind", "path", "line"} - set(symbols.columns) | {"usr", "path", "line", "role", "relation", "related"} - set(occurrences.columns):
            return None, f"index at {path} has no {', '.join(sorted(missing))}"
    except AnalysisException:
        return None, f"no index at {path}"
    try:
        units = spark.read.parquet(f"{path}/units.parquet")
    except AnalysisException:
        units = None
    return Index(symbols, occurrences, units), ""


def unreached(declarations: DataFrame, roots: DataFrame, symbols: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Declarations with a symbol that neither roots (decl) nor forced ones reach; those without one count as reached."""
    found = verdicts(declarations, roots.select(F.lit("index").alias("root_set"), "decl"), symbols, occurrences)
    return declarations.join(found, "decl", "left_anti")


def usage(symbols: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Per symbol its references, whether only its own file has any, and whether tests do."""
    skipped = F.col("name").rlike(r"^(\$.*|init|deinit|CodingKeys)$")
    own = symbols.where(~skipped).select("usr", "name", F.col("path").alias("home"))
    test = F.coalesce(F.array_contains(F.split("path", "/"), "Tests") | F.col("path").endswith("Tests.swift"), F.lit(False))
    uses = occurrences.where("role <> 'definition'").groupBy("usr").agg(F.count("*").alias("n"), F.min("path").alias("first"), F.max("path").alias("last"), F.bool_or(test).alias("tests"))
    alone = F.coalesce((F.col("first") == F.col("home")) & (F.col("last") == F.col("home")), F.lit(True))
    return own.join(uses, "usr", "left").select("usr", "name", F.coalesce("n", F.lit(0)).alias("n_references"), alone.alias("self_only"), F.coalesce("tests", F.lit(False)).alias("in_tests"))
