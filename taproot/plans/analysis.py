"""Unused declarations of a corpus or a single file, from facts to findings."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taproot.functions import text
from taproot.functions.hashing import finding_fingerprint
from taproot.operators import graph, index_oracle, policy, relations, similarity
from taproot.plans import control_flow
from taproot.sources import cache, files
from taproot.storage import shuffled, stored

RULES = ("unused-function", "unused-type", "unused-property", "unused-enum-case", "unused-import", "unused-public-api", "assign-only-property", "only-tested", "dead-branch", "dead-store")
OFF_BY_DEFAULT = frozenset({"unused-import", "unused-public-api", "assign-only-property", "dead-store"})
# Conformances whose types the system makes by itself, and interface-builder attributes of the platform.
ENTRY_CONFORMANCES = (
    "AppShortcutsProvider", "AppIntent", "AudioPlaybackIntent", "WidgetBundle", "Widget", "ControlWidget", "LiveActivity",
    "AppEntity", "EntityQuery", "TransientAppEntity",
)
BUILDER_ATTRIBUTES = ("IBAction", "IBOutlet", "IBDesignable", "IBInspectable", "IBSegueAction")
LEVELS = ("low", "medium", "high", "certain")
RANK = {"private": 0, "fileprivate": 1, "internal": 2, "package": 3, "public": 4, "open": 5}

# Names that code outside uses of a type with a conformance, by protocols of the standard library, the interface
# framework and the argument parser. Raw types have none.
EXTERNAL: dict[str, tuple[str, ...]] = {
    "Equatable": ("==",),
    "Hashable": ("==", "hash", "hashValue"),
    "Comparable": ("==", "<", "<=", ">", ">="),
    "Codable": ("init", "encode", "CodingKeys"),
    "Encodable": ("encode", "CodingKeys"),
    "Decodable": ("init", "CodingKeys"),
    "CodingKey": ("stringValue", "intValue", "init"),
    "Error": (),
    "LocalizedError": ("errorDescription", "failureReason", "recoverySuggestion", "helpAnchor"),
    "CustomStringConvertible": ("description",),
    "CustomDebugStringConvertible": ("debugDescription",),
    "Identifiable": ("id", "ID"),
    "RawRepresentable": ("rawValue", "init", "RawValue"),
    "CaseIterable": ("allCases", "AllCases"),
    "Sendable": (),
    "OptionSet": ("rawValue", "init", "RawValue"),
    "Sequence": ("makeIterator", "underestimatedCount", "Iterator", "Element"),
    "IteratorProtocol": ("next", "Element"),
    "AsyncSequence": ("makeAsyncIterator", "AsyncIterator", "Element"),
    "Collection": ("startIndex", "endIndex", "subscript", "index", "makeIterator", "Index", "Element"),
    "ExpressibleByStringLiteral": ("init",),
    "ExpressibleByIntegerLiteral": ("init",),
    "ExpressibleByArrayLiteral": ("init",),
    "ExpressibleByDictionaryLiteral": ("init",),
    "ExpressibleByNilLiteral": ("init",),
    "ExpressibleByBooleanLiteral": ("init",),
    "ExpressibleByFloatLiteral": ("init",),
    "View": ("body", "Body"),
    "ViewModifier": ("body", "Body"),
    "App": ("body", "Body", "init"),
    "Scene": ("body", "Body"),
    "PreviewProvider": ("previews", "platform"),
    "DynamicProperty": ("update",),
    "EnvironmentKey": ("defaultValue", "Value"),
    "PreferenceKey": ("defaultValue", "reduce", "Value"),
    "ObservableObject": ("objectWillChange", "ObjectWillChangePublisher"),
    "ParsableCommand": ("configuration", "run", "init"),
    "AsyncParsableCommand": ("configuration", "run", "init"),
    "ParsableArguments": ("init", "validate"),
    "ExpressibleByArgument": ("init", "defaultValueDescription", "allValueStrings"),
} | dict.fromkeys(
    (
        "AnyObject", "Actor", "Copyable", "String", "Character", "Int", "Int8", "Int16", "Int32", "Int64",
        "UInt", "UInt8", "UInt16", "UInt32", "UInt64", "Double", "Float",
    ), (),
)


MEMBERS = ("function", "method", "variable", "constant", "subscript", "typealias", "initializer", "associatedtype")
# Raw types, and protocols that make or list an enum's cases.
CONSTRUCTING = (
    "String", "Character", "Int", "Int8", "Int16", "Int32", "Int64", "UInt", "UInt8", "UInt16", "UInt32", "UInt64", "Double", "Float",
    "Codable", "Decodable", "Encodable", "CaseIterable", "RawRepresentable", "CodingKey",
)
# Property wrappers through which the platform reads or writes a property.
IMPLIED_WRAPPERS = ("AppStorage", "Binding", "Environment", "EnvironmentObject", "FocusState", "GestureState", "Namespace", "ObservedObject", "Published", "SceneStorage", "State", "StateObject")


@dataclass(frozen=True)
class Configuration:
    rules: dict[str, dict] = field(default_factory=dict)
    public_is_root: bool = True
    production: bool = False
    single_file: bool = False
    minimum_confidence: str = "low"
    #: Judge declarations that an index doesn't know: "reached" or by "syntax".
    unmapped: str = "reached"
    #: Say in notes how unlike the most similar other findings' code is: "off", "exact" (compares all) or "index".
    similarity: str = "off"

    def enabled(self, rule: str) -> bool:
        return self.rules.get(rule, {}).get("enabled", rule not in OFF_BY_DEFAULT)

    def severity(self, rule: str) -> str:
        return self.rules.get(rule, {}).get("severity", "warning")

    def routes(self) -> list[tuple[str, bool, str]]:
        return [(r, self.enabled(r), self.severity(r)) for r in RULES]


def access_rank(access: Column) -> Column:
    return F.coalesce(*(F.when(access == a, r) for a, r in RANK.items()))


def _has(names: Column, *wanted: str) -> Column:
    return F.arrays_overlap(names, F.array(*map(F.lit, wanted)))


def root_reason(config: Configuration) -> Column:
    """The first reason that holds, in order, or null."""
    c = F.col
    function = c("kind").isin("function", "method")
    bases = F.transform("conformances", text.base_name)
    reasons: list[tuple[Column, str]] = [
        (_has(c("attributes"), "main", "UIApplicationMain", "NSApplicationMain"), "main"),
        ((c("name") == "main") & (function | F.array_contains("modifiers", "static")), "main"),
        ((c("kind") == "operator") | (function & text.is_operator_name(c("name"))), "operator"),
    ]
    if config.public_is_root:
        reasons.append((c("effective") >= RANK["public"], "public"))
    reasons += [
        (_has(c("attributes"), "objc", "objcMembers"), "objc"),
        (_has(c("attributes"), *BUILDER_ATTRIBUTES), "interface builder"),
        (function & (c("name").startswith("test") | _has(c("attributes"), "Test")) & F.lit(not config.production), "test"),
        ((c("kind") == "enum") & (c("name") == "CodingKeys"), "coding keys"),
        (_has(c("attributes"), "dynamicMemberLookup", "dynamicCallable", "_silgen_name", "_cdecl", "_dynamicReplacement", "_objcRuntimeName"), "runtime"),
        (c("name").isin("wrappedValue", "projectedValue"), "property wrapper"),
        (_has(c("conformances"), *ENTRY_CONFORMANCES), "entry point"),
        (_has(bases, "View", "ViewModifier", "PreviewProvider"), "interface"),
        (c("kind").isin("variable", "constant") & _has(F.transform("attributes", text.base_name), *IMPLIED_WRAPPERS), "wrapped property"),
        (c("kind").isin("variable", "constant") & (c("name") == "body"), "body"),
        (F.array_contains("modifiers", "override"), "override"),
    ]
    if config.single_file:
        reasons.append((c("effective") > RANK["fileprivate"], "visible outside the file"))
    return policy.first_reason(reasons)


def member_roots(decls: DataFrame) -> DataFrame:
    """(decl, outer) of members that something outside the corpus uses through their type, with the first reason that holds.

    - "constructed case": a case of an enum with a raw type, or with a conformance that makes or lists cases;
    - "result builder": a member of a type with that attribute;
    - "coding": a property of a type whose coding is synthesised;
    - "external witness": code outside may call it through a protocol or base type of theirs. A type's outside
      requirements are known only if each of its outside conformances, over all its extensions, is in the catalogue;
      otherwise all of its members but private ones are exempt.
    """
    spark = decls.sparkSession
    catalogue = spark.createDataFrame([(k, list(v)) for k, v in EXTERNAL.items()], "base string, needs array<string>")
    inside = decls.where("kind IN ('protocol', 'class', 'actor', 'struct', 'enum', 'typealias')").select(F.col("name").alias("base")).distinct()
    types = decls.where("kind IN ('class', 'struct', 'enum', 'actor', 'extension')")
    written = types.select(F.col("name").alias("type"), F.explode("conformances").alias("text"))
    bases = written.select("type", F.explode(F.split("text", "&")).alias("one")).select("type", text.base_name(F.col("one")).alias("base")).distinct()
    outside = bases.join(inside, "base", "left_anti")
    constructs, codes = F.bool_or(F.col("base").isin(*CONSTRUCTING)), F.bool_or(F.col("base").isin("Codable", "Encodable", "Decodable"))
    made = bases.groupBy("type").agg(constructs.alias("constructs"))
    found = policy.known_needs(outside, catalogue).join(shuffled(outside.groupBy("type").agg(codes.alias("codes"))), "type")
    builders = types.groupBy(F.col("name").alias("type")).agg(F.bool_or(_has(F.col("attributes"), "resultBuilder")).alias("builds"))
    per_type = builders.join(made, "type", "left").join(found, "type", "left").withColumnRenamed("type", "enclosing_type")
    member = F.col("kind").isin(*MEMBERS)
    open_ = access_rank(F.col("access")) > RANK["private"]
    reason = policy.first_reason([
        ((F.col("kind") == "enumCase") & F.col("constructs"), "constructed case"),
        (member & F.col("builds"), "result builder"),
        (F.col("kind").isin("variable", "constant") & F.col("codes"), "coding"),
        (member & open_ & F.when(F.col("known"), F.array_contains("needs", F.col("name"))).otherwise(F.col("known").isNotNull()), "external witness"),
    ])
    own = decls.where(F.col("kind").isin(*MEMBERS, "enumCase")).select("decl", "name", "kind", "access", "enclosing_type")
    return own.join(per_type, "enclosing_type").select("decl", reason.alias("outer")).where("outer IS NOT NULL").distinct()


def with_effective_access(decls: DataFrame) -> DataFrame:
    """The least access of a declaration and of all that enclose it.

    An extension counts as the one type of its name, if there is one, else as internal; its own access only if that is more.
    """
    nominal = decls.where(F.col("kind").isin("class", "struct", "enum", "actor", "protocol", "typealias"))
    types = nominal.groupBy("name").agg(F.count("*").alias("types"), F.min(access_rank(F.col("access"))).alias("rank"))
    extended = types.where("types = 1").select(F.col("name"), F.col("rank").alias("extended"))
    outer = decls.where(F.col("kind").isin("class", "struct", "enum", "actor", "protocol", "extension")).join(extended, "name", "left")
    own = access_rank(F.col("access"))
    through = F.greatest(own, F.coalesce("extended", F.lit(RANK["internal"])))
    above = outer.select("path", "ordinal", F.when(F.col("kind") == "extension", through).otherwise(own).alias("above"))
    inner = decls.select("decl", "path", F.explode("enclosing").alias("ordinal"))
    least = inner.join(above, ["path", "ordinal"]).groupBy("decl").agg(F.min("above").alias("above"))
    return decls.join(least, "decl", "left").withColumn("effective", F.least(own, F.coalesce("above", own))).drop("above")


def dependency_edges(decls: DataFrame, refs: DataFrame) -> DataFrame:
    """(src, dst): what lies in a declaration's lines depends, through a node of the name, on every declaration of a name
    used there; a protocol on its requirements, and a requirement on its witnesses."""
    spans = decls.select("decl", F.col("path").alias("file"), F.col("first_line").alias("first"), F.col("last_line").alias("last"))
    names = refs.select(F.col("path").alias("file"), "line", F.explode(F.array_compact(F.array("identifier", "qualifier"))).alias("ref")).distinct()
    used = relations.references_in_range(spans, names).select(F.col("decl").alias("src"), F.col("ref").alias("name"))
    by_name = relations.name_hops(decls.select("decl", "name"), used)
    protocols = decls.where("kind = 'protocol'").select(F.col("decl").alias("src"), F.col("name").alias("enclosing_type"))
    requirements = decls.where("enclosing_kind = 'protocol'")
    own = protocols.join(requirements.select(F.col("decl").alias("dst"), "enclosing_type"), "enclosing_type").select("src", "dst")
    conformances = decls.select(F.col("name").alias("type"), F.explode(F.transform("conformances", text.base_name)).alias("protocol")).distinct()
    members = decls.where("enclosing_type IS NOT NULL AND enclosing_kind <> 'protocol'").select(F.col("decl").alias("member"), F.col("enclosing_type").alias("type"), "name")
    wanted = requirements.select(F.col("decl").alias("requirement"), F.col("enclosing_type").alias("protocol"), "name")
    witness = relations.witnesses(wanted, members, conformances).select(F.col("requirement").alias("src"), F.col("member").alias("dst"))
    return graph.dedupe_edges(by_name.unionByName(own).unionByName(witness))


def test_containers(decls: DataFrame) -> DataFrame:
    """(path, ordinal) of types and extensions that hold tests: suites, and what descends from XCTestCase over types of the corpus."""
    types = decls.where(F.col("kind").isin("class", "struct", "enum", "actor", "extension", "protocol"))
    bases = types.select(F.col("name").alias("dst"), F.explode("conformances").alias("all")).select("dst", F.explode(F.split("all", "&")).alias("one"))
    root = decls.sparkSession.createDataFrame([("tests", "XCTestCase")], "root_set string, node string")
    descends = graph.reachable(bases.select(text.base_name(F.trim("one")).alias("src"), "dst"), root).select(F.col("node").alias("name"))
    own = types.where("kind <> 'protocol'")
    suites = own.where(_has(F.col("attributes"), "Suite")).select("path", "ordinal")
    return suites.unionByName(own.join(descends, "name", "left_semi").select("path", "ordinal")).distinct()


def with_test_scope(decls: DataFrame) -> DataFrame:
    """``in_tests``: in a test file, marked as a test, named like one, or in or itself a container of tests, however deep."""
    containers = test_containers(decls)
    inner = decls.select("decl", "path", F.explode(F.concat("enclosing", F.array("ordinal"))).alias("ordinal"))
    inside = inner.join(containers, ["path", "ordinal"], "left_semi").select("decl").distinct().withColumn("contained", F.lit(True))
    named = F.col("kind").isin("function", "method") & F.col("name").startswith("test")
    marked = _has(F.col("attributes"), "Test", "Suite")
    scoped = F.coalesce(text.is_test_path(F.col("path")), F.lit(False)) | marked | named | F.coalesce("contained", F.lit(False))
    return decls.join(inside, "decl", "left").withColumn("in_tests", scoped).drop("contained")


def _rule() -> Column:
    kind = F.col("kind")
    return F.when(F.col("reason") == "only tested", "only-tested").when(F.col("effective") >= RANK["public"], "unused-public-api").when(kind.isin("function", "method"), "unused-function").when(kind.isin("class", "struct", "enum", "protocol", "actor", "typealias"), "unused-type").when(kind.isin("variable", "constant"), "unused-property").when(kind == "enumCase", "unused-enum-case")


@dataclass
class Report:
    findings: DataFrame
    suppressed: DataFrame
    degraded: DataFrame

    #: What a user should know about the run: which oracle judged, and why.
    notes: list[str] = field(default_factory=list)
    #: Files taken from the cache, analysed anew and gone, where a cache is used.
    cached: dict[str, int] = field(default_factory=dict)

    def ordered(self) -> list:
        return self.findings.orderBy("path", "line", "column", "rule").collect()

    def relative_to(self, root: str) -> Report:
        """The same with paths below ``root`` relative to it, in paths, messages, notes and degraded rows, and in fingerprints."""
        prefix = root.rstrip("/") + "/"
        cut = {c: F.replace(F.col(c), F.lit(prefix), F.lit("")) for c in ("message", "note")}

        def short(df: DataFrame) -> DataFrame:
            return anchored(df.withColumns(cut | {"path": text.relative_path(F.col("path"), root)}), root)

        degraded = self.degraded.withColumns({"path": text.relative_path(F.col("path"), root), "degraded": F.replace("degraded", F.lit(prefix), F.lit(""))})
        return Report(short(self.findings), short(self.suppressed), degraded, self.notes, self.cached)


def anchored(found: DataFrame, root: str) -> DataFrame:
    """Findings whose fingerprints spell paths relative to ``root``, so that they are the same on every machine."""
    path = text.relative_path(F.col("path"), root)
    return found.withColumn("fingerprint", finding_fingerprint(F.col("rule"), path, F.col("line"), F.col("column"), F.col("message")))


def common_root(paths: DataFrame) -> str:
    """The folder that holds all paths: what the least and the greatest have in common, all have."""
    ends = paths.agg(F.min("path").alias("least"), F.max("path").alias("most")).first()
    return os.path.dirname(os.path.commonprefix([ends["least"] or "/", ends["most"] or "/"]) + "x")


def reached_by_index(known: DataFrame, roots: DataFrame, syntax: DataFrame, config: Configuration, index: index_oracle.Index) -> DataFrame | None:
    """(root_set, node) by the index, or None if it covers none of the declarations."""
    if not index_oracle.mapped(known, index.symbols).limit(1).count():
        return None
    given = syntax.select("root_set", F.col("node").alias("decl")) if config.unmapped == "syntax" else None
    found = index_oracle.verdicts(known, roots.select("root_set", F.col("node").alias("decl")), index.symbols, index.occurrences, given)
    return found.select("root_set", F.col("decl").alias("node"))


def unused(decls: DataFrame, refs: DataFrame, config: Configuration, index: index_oracle.Index | None = None, notes: list[str] | None = None) -> DataFrame:
    """Declarations that no root reaches, with a reason. ``notes`` gets which oracle judged."""
    known = decls.withColumn("root", root_reason(config)).join(member_roots(decls), "decl", "left")
    known = with_test_scope(known) if config.production else known.withColumn("in_tests", F.lit(False))
    known = stored(known.withColumn("root", F.coalesce("root", "outer")).drop("outer"))
    plain = known.where((F.col("name") != "_") & ~F.col("name").startswith("`") & ~F.col("name").rlike("Tests?$"))
    if config.single_file:
        dead = relations.unused_names(plain.where("root IS NULL AND NOT (enclosing_kind <=> 'protocol')"), refs.select(F.col("identifier").alias("name")))
        return dead.withColumn("reason", F.lit("never referenced"))
    edges = dependency_edges(known, refs)
    roots = known.where("root IS NOT NULL").select(F.lit("all").alias("root_set"), F.col("decl").alias("node"))
    if config.production:
        roots = roots.where("root_set = 'all'").union(known.where("in_tests").select(F.lit("all"), "decl")).union(known.where("root IS NOT NULL AND NOT in_tests").select(F.lit("production"), "decl"))
    found = stored(graph.reachable(edges, roots))
    if index is not None:
        judged = reached_by_index(known, roots, found, config, index)
        (notes if notes is not None else []).append("the index judges" if judged is not None else "the index covers none of the files; names judge")
        found = found if judged is None else judged
    all_ = found.where("root_set = 'all'").select(F.col("node").alias("decl"))
    dead = plain.join(all_, "decl", "left_anti").withColumn("reason", F.lit("never referenced"))
    if not config.production:
        return dead
    tested = plain.where("NOT in_tests").join(all_, "decl", "left_semi").join(found.where("root_set = 'production'").select(F.col("node").alias("decl")), "decl", "left_anti")
    return dead.unionByName(tested.withColumn("reason", F.lit("only tested")))


def runtime_members(decls: DataFrame) -> DataFrame:
    """(decl) of members without ``objc`` whose type is NSObject's or descends from it: a runtime may call them by name."""
    edges = decls.where("kind <> 'parameter'").select(F.explode(F.transform("conformances", text.base_name)).alias("src"), F.coalesce(F.when(F.col("kind") != "extension", F.col("name")), "enclosing_type", "name").alias("dst"))
    root = decls.sparkSession.createDataFrame([("runtime", "NSObject")], "root_set string, node string")
    types = graph.reachable(edges, root).select(F.col("node").alias("enclosing_type"))
    return decls.where(~_has(F.col("attributes"), "objc")).join(types, "enclosing_type", "left_semi").select("decl")


def findings(dead: DataFrame, tokens: DataFrame, runtime: DataFrame, config: Configuration) -> DataFrame:
    """Collapsed, routed, weighed and worded findings; ``runtime`` has the (decl) that a runtime may call."""
    gated = dead.where(F.col("kind").isin("constant", "variable", "function", "method", "class", "enum", "protocol", "struct", "actor", "typealias", "enumCase"))
    flagged = dead.where(F.col("kind").isin(*("class", "struct", "enum", "protocol", "actor"))).select("path", F.col("ordinal").alias("owner"))
    inside = gated.select("decl", "path", F.explode("enclosing").alias("owner")).join(shuffled(flagged), ["path", "owner"], "left_semi").select("decl").distinct()
    own = gated.join(shuffled(inside), "decl", "left_anti").withColumn("rule", _rule())
    own = policy.routed(own, config.routes())
    base = F.when(F.col("effective") <= RANK["fileprivate"], 3).when(F.col("effective") == RANK["internal"], 2).otherwise(1)
    named = tokens.select(F.col("token").alias("name"), F.lit(True).alias("named"))
    level = policy.demoted(base, F.coalesce("named", F.lit(False)), F.coalesce("runtime_visible", F.lit(False)))
    own = own.join(named, "name", "left").join(shuffled(runtime.distinct().withColumn("runtime_visible", F.lit(True))), "decl", "left").withColumn("confidence", F.array(*map(F.lit, LEVELS))[level - 1])
    word = F.when(F.col("kind") == "enumCase", "enum case").when(F.col("kind").isin("variable", "constant"), "property").otherwise(F.col("kind"))
    message = F.concat(word, F.lit(" '"), F.col("name"), F.lit("' is "), F.when(F.col("reason") == "only tested", "used by tests only").otherwise("never used" + (" in this file" if config.single_file else "")))
    note = F.concat(F.lit("confidence "), F.col("confidence"), F.when(F.col("named"), "; its name is in a string").when(F.col("runtime_visible"), "; a runtime may call it by name").otherwise(""))
    out = own.select("rule", "severity", "path", "line", "column", message.alias("message"), note.alias("note"), "confidence")
    return out.withColumn("fingerprint", finding_fingerprint(F.col("rule"), F.col("path"), F.col("line"), F.col("column"), F.col("message")))


def flow_findings(facts: DataFrame, config: Configuration) -> DataFrame:
    """Findings of dead branches (certain) and dead stores (high), per line of their function."""
    rows, found = control_flow.bodies(facts), None
    for rule, of in (("dead-branch", control_flow.dead_branches), ("dead-store", control_flow.dead_stores)):
        if config.enabled(rule):
            own = of(rows).withColumn("rule", F.lit(rule))
            found = own if found is None else found.unionByName(own)
    own = policy.routed(found, config.routes())
    branch = F.col("rule") == "dead-branch"
    message = F.when(branch, F.concat(F.lit("branch '"), F.col("what"), F.lit("' never runs in "), F.col("function"))).otherwise(F.concat(F.lit("value stored in '"), F.col("what"), F.lit("' is overwritten before any read in "), F.col("function")))
    confidence = F.when(branch, "certain").otherwise("high")
    out = own.select("rule", "severity", "path", "line", F.lit(1).alias("column"), message.alias("message"), F.concat(F.lit("confidence "), confidence).alias("note"), confidence.alias("confidence"))
    return out.withColumn("fingerprint", finding_fingerprint(F.col("rule"), F.col("path"), F.col("line"), F.col("column"), F.col("message"))).dropDuplicates(["fingerprint"])


def opt_in_findings(facts: DataFrame, decls: DataFrame, refs: DataFrame, config: Configuration) -> DataFrame:
    """Unused imports and properties that are only written, where these rules are on."""
    imports = decls.where((F.col("kind") == "import") & ~F.array_contains("attributes", "_exported"))
    unused_ = relations.unused_imports(imports.select("path", "line", "column", F.col("path").alias("file"), F.col("name").alias("module")), refs.withColumn("file", F.col("path")))
    found = unused_.select(F.lit("unused-import").alias("rule"), "path", "line", "column", F.concat(F.lit("import '"), F.col("module"), F.lit("' is never used in this file")).alias("message"))
    written = relations.assign_only(refs, "identifier", F.col("context") == "write").select(F.col("identifier").alias("name"))
    only = decls.where("kind IN ('variable', 'constant') AND NOT local").join(written, "name", "left_semi")
    found = found.unionByName(only.select(F.lit("assign-only-property").alias("rule"), "path", "line", "column", F.concat(F.lit("property '"), F.col("name"), F.lit("' is written and never read")).alias("message")))
    out = policy.routed(found, config.routes()).select("rule", "severity", "path", "line", "column", "message", F.lit("confidence medium").alias("note"), F.lit("medium").alias("confidence"))
    return out.withColumn("fingerprint", finding_fingerprint(F.col("rule"), F.col("path"), F.col("line"), F.col("column"), F.col("message")))


def suppression(found: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, suppressed) by accepting comments on the line or the one before, and by the last toggle above."""
    comments = facts.select("path", F.explode("comments").alias("c")).select("path", F.col("c.line").alias("line"), text.directive(F.col("c.text"), list(RULES)).alias("d")).where("d IS NOT NULL")
    every = F.when(F.size("d.rules") > 0, F.col("d.rules")).otherwise(F.array(*map(F.lit, RULES)))
    said = comments.select("path", "line", "d.verb", F.explode(every).alias("rule"))
    asked = found.select("path", "rule", "line", "fingerprint")
    point = relations.suppressed_at_point(asked, said.where("verb IN ('accept', 'accept-next', 'expect')"), ("path", "rule")).select("fingerprint")
    toggles = said.where("verb IN ('disable', 'enable')").select("path", "rule", "line", F.lit(None).cast("string").alias("fingerprint"), "verb")
    rows = asked.withColumn("verb", F.lit(None).cast("string")).unionByName(toggles)
    # Toggles come before the findings of their line; of two on one line, that which enables is the last.
    order = [F.col("line"), F.col("fingerprint").isNotNull(), F.col("verb")]
    last = relations.region_state(["path", "rule"], order, F.col("verb"))
    off = rows.withColumn("last", last).where("fingerprint IS NOT NULL AND last = 'disable'").select("fingerprint")
    gone = point.union(off).distinct()
    return found.join(gone, "fingerprint", "left_anti"), found.join(gone, "fingerprint", "left_semi")


#: Lines of a declaration after its first that its vector is made of, at most.
SNIPPET_LINES = 40


def snippets(found: DataFrame, decls: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, snippet): the lines of each finding's declaration, or the finding's own line where no declaration is there.

    A file's source is read once for all of its findings; these are as many as its declarations and statements at most.
    """
    spans = decls.groupBy("path", "line", "column").agg(F.max("last_line").alias("last_line"))
    own = found.select("id", "path", "line", "column").distinct().join(spans, ["path", "line", "column"], "left")
    last = F.least(F.coalesce("last_line", "line"), F.col("line") + SNIPPET_LINES)
    spots = own.groupBy("path").agg(F.collect_list(F.struct("id", F.greatest("line", F.lit(1)).alias("line"), last.alias("last"))).alias("spots"))
    lined = shuffled(spots).join(sources.select("path", F.split("source", "\n").alias("lines")), "path", "left").select("lines", F.explode("spots").alias("s"))
    text_ = F.array_join(F.slice("lines", F.col("s.line"), F.greatest(F.col("s.last") - F.col("s.line") + 1, F.lit(0))), "\n")
    return lined.select("s.id", F.coalesce(text_, F.lit("")).alias("snippet"))


def with_similarity_notes(found: DataFrame, decls: DataFrame, sources: DataFrame, how: str, notes: list[str]) -> DataFrame:
    """Findings whose notes end with how unlike the nearest others' code theirs is; which findings there are stays as it is.

    Equal findings share a note. A single finding has no other, so it keeps its note, and ``notes`` says so.
    """
    if how not in ("exact", "index"):
        raise ValueError(f"similarity is off, exact or index, not {how}")
    own = stored(found.withColumn("id", F.xxhash64("path", "line", "column", "rule", "message")))
    n = own.select("id").distinct().count()
    if n < 2:
        notes.append("similarity needs more than one finding; notes are as they were")
        return own.drop("id")
    vectors = similarity.gram_vectors(snippets(own, decls, sources), "snippet", "id").withColumn("v", F.col("v").cast("array<float>"))  # counts below 2^24 stay as they are
    scores = similarity.anomaly(vectors) if how == "exact" else similarity.anomaly_by_index(vectors)
    percent = F.round(F.col("anomaly") * 100).cast("int").cast("string")
    # Fixed value: the words that tools look for in a note.
    said = F.concat(F.lit("embedding-confidence: "), percent, F.lit("% anomaly [experimental, character n-grams]"))
    notes.append(f"similarity noted on {n} findings by character n-grams")
    return own.join(scores, "id", "left").withColumn("note", F.when(F.col("anomaly").isNull(), F.col("note")).otherwise(F.concat_ws("; ", "note", said))).select(*found.columns)


def analyze(spark: SparkSession, sources: DataFrame, config: Configuration = Configuration(), index: index_oracle.Index | str | None = None, cache_at: str | None = None, anchor: str | None = None) -> Report:
    """Findings of all files together; with ``single_file`` each file stands alone (one file at a time is meant).

    An ``index`` (or the folder of one) judges what is reached; if it can't be read or covers none of the files, names do, with a note.
    ``cache_at`` names a folder of snapshots, from which unchanged files' facts come. Fingerprints spell paths relative to ``anchor``.
    """
    notes: list[str] = []
    if isinstance(index, str):
        index, why = index_oracle.opened(spark, index)
        notes += [f"{why}; names judge"] if why else []
    if index is not None and index.units is not None and "modified" in sources.columns:
        n = index_oracle.stale(sources, index.units).count()
        notes += [f"the index is older than {n} of the files"] if n else []
    facts, counts = cache.facts_through(spark, sources, cache_at) if cache_at else (stored(files.facts(sources)), {})
    decls, refs = stored(with_effective_access(files.declarations(facts))), files.references(facts)
    dead = unused(decls, refs, config, index, notes)
    found = findings(dead, files.string_tokens(facts), runtime_members(decls), config)
    if any(map(config.enabled, ("dead-branch", "dead-store"))):
        found = found.unionByName(flow_findings(facts, config))
    if any(map(config.enabled, ("unused-import", "assign-only-property"))):
        found = found.unionByName(opt_in_findings(facts, decls, refs, config))
    floor = LEVELS.index(config.minimum_confidence)
    found = found.where(F.col("confidence").isin(*LEVELS[floor:]))
    kept, gone = suppression(stored(anchored(found, anchor) if anchor else found), facts)
    if config.similarity != "off":
        kept = with_similarity_notes(kept, decls, sources, config.similarity, notes)
    return Report(kept, gone, facts.where("degraded IS NOT NULL").select("path", "degraded"), notes, counts)
