"""Queries that bind every operator to tables, each with the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taproot.functions import hashing, text
from taproot.operators import constants, dataflow, graph, index_oracle, policy, relations, similarity
from taproot.plans import analysis
from taproot.sources import sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _key(prefix: str, column: str) -> F.Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def tables_graph(spark: SparkSession, d: str) -> DataFrame:
    """Edges between rows: region, nation, customer and supplier, order, part and supplier."""
    pair = lambda df, a, x, b, y: df.select(_key(a, x).alias("src"), _key(b, y).alias("dst"))
    nation, items = _t(spark, d, "nation"), _t(spark, d, "lineitem")
    parts = [
        pair(nation, "R", "n_regionkey", "N", "n_nationkey"),
        pair(_t(spark, d, "customer"), "N", "c_nationkey", "C", "c_custkey"),
        pair(_t(spark, d, "supplier"), "N", "s_nationkey", "S", "s_suppkey"),
        pair(_t(spark, d, "orders"), "C", "o_custkey", "O", "o_orderkey"),
        pair(items, "O", "l_orderkey", "P", "l_partkey"),
        pair(items, "O", "l_orderkey", "S", "l_suppkey"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return graph.dedupe_edges(out)


_EDGES = """edges AS (SELECT 'R' || n_regionkey AS src, 'N' || n_nationkey AS dst FROM nation UNION SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer
 UNION SELECT 'N' || s_nationkey, 'S' || s_suppkey FROM supplier UNION SELECT 'C' || o_custkey, 'O' || o_orderkey FROM orders
 UNION SELECT 'O' || l_orderkey, 'P' || l_partkey FROM lineitem UNION SELECT 'O' || l_orderkey, 'S' || l_suppkey FROM lineitem)"""


def _roots(spark: SparkSession, *rows: tuple[str, str]) -> DataFrame:
    return spark.createDataFrame(list(rows), "root_set string, node string")


@query(f"WITH RECURSIVE {_EDGES}, r(node) AS (SELECT 'R0' UNION SELECT dst FROM r JOIN edges ON src = node) SELECT node FROM r")
def q_bfs_reachable(spark: SparkSession, d: str) -> DataFrame:
    return graph.reachable(tables_graph(spark, d), _roots(spark, ("a", "R0"))).select("node")


@query(f"WITH RECURSIVE {_EDGES}, r(node) AS (SELECT 'R0' UNION SELECT dst FROM r JOIN edges ON src = node), n AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges) SELECT node FROM n WHERE node NOT IN (SELECT node FROM r)")
def q_bfs_unreachable(spark: SparkSession, d: str) -> DataFrame:
    edges = tables_graph(spark, d)
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return graph.unreachable(nodes, edges, _roots(spark, ("a", "R0"))).select("node")


@query(f"WITH RECURSIVE {_EDGES}, a(node) AS (SELECT 'R0' UNION SELECT dst FROM a JOIN edges ON src = node), b(node) AS (SELECT unnest(['R0', 'R1']) UNION SELECT dst FROM b JOIN edges ON src = node) SELECT node FROM b WHERE node NOT IN (SELECT node FROM a)")
def q_two_root_sets(spark: SparkSession, d: str) -> DataFrame:
    return graph.only_reached_by(tables_graph(spark, d), _roots(spark, ("tests", "R0"), ("tests", "R1"), ("production", "R0")), "tests", "production")


@query("SELECT l_orderkey AS src, count(DISTINCT l_partkey) AS out_degree FROM lineitem GROUP BY 1")
def q_edge_dedupe_outdegree(spark: SparkSession, d: str) -> DataFrame:
    return graph.out_degree(_t(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")))


def _tree(spark: SparkSession, d: str) -> DataFrame:
    pair = lambda df, a, x, b, y: df.select(_key(a, x).alias("node"), _key(b, y).alias("parent"))
    return pair(_t(spark, d, "orders"), "O", "o_orderkey", "C", "o_custkey").union(pair(_t(spark, d, "customer"), "C", "c_custkey", "N", "c_nationkey")).union(pair(_t(spark, d, "nation"), "N", "n_nationkey", "R", "n_regionkey"))


_TREE = "tree AS (SELECT 'O' || o_orderkey AS node, 'C' || o_custkey AS parent FROM orders UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation)"


@query(f"WITH RECURSIVE {_TREE}, up AS (SELECT node, parent AS ancestor, 1 AS depth FROM tree UNION ALL SELECT up.node, tree.parent, depth + 1 FROM up JOIN tree ON tree.node = up.ancestor) SELECT node, ancestor, depth FROM up")
def q_scope_chain(spark: SparkSession, d: str) -> DataFrame:
    return graph.ancestors(_tree(spark, d))


@query(f"WITH RECURSIVE {_TREE}, up AS (SELECT node, parent AS ancestor FROM tree UNION ALL SELECT up.node, tree.parent FROM up JOIN tree ON tree.node = up.ancestor), a AS (SELECT node, node AS ancestor FROM tree UNION ALL SELECT node, ancestor FROM up) SELECT node, min(CAST(substr(ancestor, 2) AS BIGINT) % 6) AS rank FROM a WHERE node LIKE 'O%' GROUP BY node")
def q_effective_access(spark: SparkSession, d: str) -> DataFrame:
    tree = _tree(spark, d)
    nodes = tree.select("node").union(tree.where("parent LIKE 'R%'").select("parent")).distinct()
    levels = nodes.withColumn("rank", F.substring("node", 2, 20).cast("long") % 6)
    return graph.effective_rank(levels, graph.ancestors(tree)).where("node LIKE 'O%'")


@query("WITH RECURSIVE c(name, ancestor) AS (SELECT p_partkey, p_partkey // 2 FROM part WHERE p_partkey > 1 UNION SELECT name, ancestor // 2 FROM c WHERE ancestor > 1) SELECT name, ancestor FROM c")
def q_transitive_conformance(spark: SparkSession, d: str) -> DataFrame:
    return graph.closure(_t(spark, d, "part").where("p_partkey > 1").select(F.col("p_partkey").alias("name"), F.expr("p_partkey div 2").alias("parent")))


def event_lines(spark: SparkSession, d: str) -> DataFrame:
    """Events as lines of a file per user."""
    return _t(spark, d, "events").select("event_id", "event_type", F.col("user_id").alias("file"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("line"))


_LINES = "lines AS (SELECT event_id, event_type, user_id AS file, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line FROM events)"


@query(f"WITH {_LINES} SELECT a.event_id AS decl, count(*) AS n_refs FROM lines a JOIN lines b ON a.file = b.file AND b.line BETWEEN a.line AND a.line + 5 WHERE a.event_type = 'signup' GROUP BY 1")
def q_interval_refs(spark: SparkSession, d: str) -> DataFrame:
    lines = event_lines(spark, d)
    spans = lines.where("event_type = 'signup'").select(F.col("event_id").alias("decl"), "file", F.col("line").alias("first"), (F.col("line") + 5).alias("last"))
    return relations.references_in_range(spans, lines.select(F.col("event_id").alias("ref"), "file", "line")).groupBy("decl").agg(F.count("*").alias("n_refs"))


_TOKENS = "list_filter(string_split_regex({}, '[^A-Za-z0-9_]+'), lambda t: regexp_matches(t, '^[A-Za-z_]'))"


@query(f"WITH decl AS (SELECT DISTINCT item_id, unnest({_TOKENS.format('text')}) AS name FROM benchmark), uses AS (SELECT DISTINCT conv_id, unnest({_TOKENS.format('text')}) AS name FROM conversations) SELECT item_id AS dst, count(DISTINCT conv_id) AS n_users FROM decl JOIN uses USING (name) GROUP BY 1")
def q_name_join(spark: SparkSession, d: str) -> DataFrame:
    names = lambda t, key, out: _t(spark, d, t).select(F.col(key).alias(out), F.explode(text.identifier_tokens(F.col("text"), True)).alias("name"))
    edges = relations.name_edges(names("benchmark", "item_id", "decl").distinct(), names("conversations", "conv_id", "src"))
    return edges.groupBy("dst").agg(F.count("*").alias("n_users"))


@query(f"WITH t AS (SELECT DISTINCT unnest({_TOKENS.format('text')}) AS name FROM documents) SELECT DISTINCT item_id, b.name FROM (SELECT item_id, unnest({_TOKENS.format('text')}) AS name FROM benchmark) b WHERE EXISTS (SELECT 1 FROM t WHERE t.name = b.name)")
def q_string_token_semi(spark: SparkSession, d: str) -> DataFrame:
    names = lambda t: _t(spark, d, t).select("*", F.explode(text.identifier_tokens(F.col("text"), True)).alias("name"))
    return names("benchmark").select("item_id", "name").distinct().join(names("documents").select("name").distinct(), "name", "left_semi").select("item_id", "name")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def q_name_antijoin_unused(spark: SparkSession, d: str) -> DataFrame:
    return relations.unused_names(_t(spark, d, "customer").select("c_custkey", F.col("c_custkey").alias("name")), _t(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("name"))).select("c_custkey")


@query("SELECT o_orderkey AS file, o_custkey AS module FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_partkey = o_custkey) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey = o_custkey)")
def q_import_unused(spark: SparkSession, d: str) -> DataFrame:
    refs = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_partkey").alias("identifier"), F.col("l_suppkey").alias("qualifier"))
    return relations.unused_imports(_t(spark, d, "orders").select(F.col("o_orderkey").alias("file"), F.col("o_custkey").alias("module")), refs)


@query("SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_quantity > 40 GROUP BY 1 HAVING bool_and(l_returnflag = 'N')")
def q_assign_only(spark: SparkSession, d: str) -> DataFrame:
    return relations.assign_only(_t(spark, d, "lineitem").where("l_quantity > 40"), "l_partkey", F.col("l_returnflag") == "N")


_ROOTS_SQL = "CASE WHEN p_size = 1 THEN 'entry' WHEN p_brand = 'Brand#11' THEN 'public' WHEN p_type LIKE '%STEEL%' THEN 'exported' WHEN starts_with(p_name, 'a') THEN 'test' WHEN p_size > 45 THEN 'large' END"


@query(f"SELECT p_partkey, {_ROOTS_SQL} AS root_reason FROM part WHERE p_size BETWEEN 1 AND 40 OR p_size > 45")
def q_kind_gate_roots(spark: SparkSession, d: str) -> DataFrame:
    # Ordered: the first reason that holds wins.
    reasons = [(F.col("p_size") == 1, "entry"), (F.col("p_brand") == "Brand#11", "public"), (F.col("p_type").contains("STEEL"), "exported"), (F.col("p_name").startswith("a"), "test"), (F.col("p_size") > 45, "large")]
    return _t(spark, d, "part").where("p_size BETWEEN 1 AND 40 OR p_size > 45").select("p_partkey", policy.first_reason(reasons).alias("root_reason"))


_CATALOGUE = [(k, k % 3 == 0, f"need{k % 4}") for k in range(20)]
_CATALOGUE_SQL = "(VALUES " + ", ".join(f"({k}, {str(known).lower()}, '{n}')" for k, known, n in _CATALOGUE) + ") AS c(n, known, need)"


@query(f"WITH u AS (SELECT s_suppkey, (s_suppkey + i) % 25 AS n FROM supplier, (SELECT unnest([0, 3]) AS i)), j AS (SELECT s_suppkey, coalesce(known, false) AS known, need FROM u LEFT JOIN {_CATALOGUE_SQL} USING (n)) SELECT s_suppkey AS type, CASE WHEN bool_and(known) THEN array_to_string(list_sort(list(DISTINCT need)), ',') END AS needs FROM j GROUP BY 1")
def q_catalog_unknown_exempt(spark: SparkSession, d: str) -> DataFrame:
    # A type's requirements are known only if each of its conformances is: null means exempt.
    uses = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("type"), F.explode(F.array(F.col("s_suppkey") % 25, (F.col("s_suppkey") + 3) % 25)).alias("base"))
    catalogue = spark.createDataFrame([(k, [need]) for k, known, need in _CATALOGUE if known], "base long, needs array<string>")
    return policy.known_needs(uses, catalogue).select("type", F.when(F.col("known"), F.array_join("needs", ",")).alias("needs"))


@query("SELECT page_id, list_contains(string_split(url, '/'), 'en') OR ends_with(url, '.html') AS is_test FROM pages")
def q_test_scope(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", (text.has_component(F.col("url"), "en") | F.col("url").endswith(".html")).alias("is_test"))


@query(r"SELECT page_id FROM pages WHERE regexp_full_match(url, '(?:.*/)?en/[^/]*\.html')")
def q_glob_match(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").where(text.glob_match(F.col("url"), "**/en/*.html")).select("page_id")


@query("SELECT p_partkey FROM part WHERE NOT ends_with(p_name, 'n') AND NOT contains(p_name, 'red') AND NOT regexp_matches(p_name, '^[a-c]')")
def q_fp_filter(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("p_name")
    return _t(spark, d, "part").where(~name.endswith("n") & ~text.excluded(name, ["red", ""]) & ~text.matches_any(name, ["^[a-c]", "(a+)+b"])).select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)")
def q_collapse(spark: SparkSession, d: str) -> DataFrame:
    flagged = _t(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("owner"))
    return relations.collapsed(_t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("owner")), flagged).select("o_orderkey")


_STEP = "CASE confidence WHEN 4 THEN 3 WHEN 3 THEN 2 ELSE 1 END"


@query(f"WITH b AS (SELECT p_partkey, CASE WHEN p_size < 10 THEN 3 WHEN p_size < 30 THEN 2 ELSE 1 END AS confidence, p_brand, p_type FROM part), s AS (SELECT DISTINCT p_brand FROM part WHERE p_size = 50) SELECT p_partkey, CAST(CASE WHEN p_brand IN (SELECT p_brand FROM s) THEN 1 WHEN p_type LIKE '%BRASS%' THEN {_STEP} ELSE confidence END AS INTEGER) AS confidence FROM b")
def q_confidence_demote(spark: SparkSession, d: str) -> DataFrame:
    part = _t(spark, d, "part")
    base = part.select("p_partkey", F.expr("CASE WHEN p_size < 10 THEN 3 WHEN p_size < 30 THEN 2 ELSE 1 END").alias("confidence"), "p_brand", "p_type")
    named = part.where("p_size = 50").select("p_brand").distinct().withColumn("named", F.lit(True))
    found = base.join(named, "p_brand", "left")
    return found.select("p_partkey", policy.demoted(F.col("confidence"), F.col("named"), F.col("p_type").contains("BRASS")).alias("confidence"))


_RULES = [("unused-function", True, "warning"), ("unused-type", True, "error"), ("dead-store", False, "warning")]
_ROUTE = "CASE WHEN o_orderstatus = 'F' THEN 'dead-store' WHEN o_orderpriority LIKE '1%' THEN 'unused-type' ELSE 'unused-function' END"


@query(f"SELECT o_orderkey, rule, severity FROM (SELECT o_orderkey, {_ROUTE} AS rule FROM orders) o JOIN (VALUES {', '.join(f'({r!r}, {str(e).lower()}, {s!r})' for r, e, s in _RULES)}) AS r(rule, enabled, severity) USING (rule) WHERE enabled")
def q_rule_route(spark: SparkSession, d: str) -> DataFrame:
    return policy.routed(_t(spark, d, "orders").select("o_orderkey", F.expr(_ROUTE).alias("rule")), _RULES)


@query(f"WITH {_LINES} SELECT event_id FROM lines f WHERE event_type = 'purchase' AND EXISTS (SELECT 1 FROM lines a WHERE a.event_type = 'click' AND a.file = f.file AND f.line - a.line IN (0, 1))")
def q_suppress_point(spark: SparkSession, d: str) -> DataFrame:
    lines = event_lines(spark, d)
    return relations.suppressed_at_point(lines.where("event_type = 'purchase'"), lines.where("event_type = 'click'")).select("event_id")


@query("WITH s AS (SELECT event_id, event_type, last_value(CASE event_type WHEN 'error' THEN 'off' WHEN 'signup' THEN 'on' END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS state FROM events) SELECT event_id, coalesce(state = 'off', false) AS suppressed FROM s WHERE event_type = 'purchase'")
def q_suppress_region_asof(spark: SparkSession, d: str) -> DataFrame:
    toggle = F.expr("CASE event_type WHEN 'error' THEN 'off' WHEN 'signup' THEN 'on' END")
    state = relations.region_state("user_id", [F.col("ts"), F.col("event_id")], toggle)
    return _t(spark, d, "events").withColumn("state", state).where("event_type = 'purchase'").select("event_id", F.coalesce(F.col("state") == "off", F.lit(False)).alias("suppressed"))


_COMMENT = "'// @tr:' || CASE o_orderkey % 4 WHEN 0 THEN 'accept' WHEN 1 THEN 'disable' WHEN 2 THEN 'enable' ELSE 'nothing' END || ' ' || CASE o_orderkey % 3 WHEN 0 THEN 'unused-type, dead-store' WHEN 1 THEN 'no-such-rule' ELSE '' END || ' -- by ' || o_orderpriority"


@query(f"""WITH c AS (SELECT o_orderkey, {_COMMENT} AS comment FROM orders), p AS (SELECT o_orderkey, regexp_extract(comment, '@tr:([a-z-]+)', 1) AS verb, list_filter(string_split_regex(regexp_replace(regexp_extract(comment, '@tr:[a-z-]+\\s*(.*)$', 1), '--.*$', ''), '[,\\s]+'), lambda r: r <> '') AS named, regexp_extract(comment, '--\\s*(.*)$', 1) AS reason FROM c)
SELECT o_orderkey, verb, array_to_string(list_filter(named, lambda r: r IN ('unused-function', 'unused-type', 'dead-store')), ',') AS rules, reason FROM p WHERE verb IN ('accept', 'disable', 'enable') AND (len(named) = 0 OR len(list_filter(named, lambda r: r IN ('unused-function', 'unused-type', 'dead-store'))) > 0)""")
def q_directive_parse(spark: SparkSession, d: str) -> DataFrame:
    comments = _t(spark, d, "orders").select("o_orderkey", F.expr(_COMMENT).alias("comment"))
    found = comments.withColumn("d", text.directive(F.col("comment"), [r for r, *_ in _RULES])).where("d IS NOT NULL")
    return found.select("o_orderkey", "d.verb", F.array_join("d.rules", ",").alias("rules"), "d.reason")


@query("SELECT o_orderkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AS in_scope FROM orders")
def q_scope_split(spark: SparkSession, d: str) -> DataFrame:
    scope = _t(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    inside, outside = relations.split_by(_t(spark, d, "orders").select("o_orderkey", "o_custkey"), scope, ["o_custkey"])
    return inside.select("o_orderkey", F.lit(True).alias("in_scope")).union(outside.select("o_orderkey", F.lit(False)))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus || '|' || o_orderpriority || '|' || (o_custkey % 50) NOT IN (SELECT o_orderstatus || '|' || o_orderpriority || '|' || (o_custkey % 50) FROM orders WHERE o_orderkey % 40 = 0)")
def q_baseline_filter(spark: SparkSession, d: str) -> DataFrame:
    orders = _t(spark, d, "orders").select("o_orderkey", hashing.finding_fingerprint(F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_custkey") % 50, F.lit(1), F.lit("")).alias("fingerprint"))
    _, new = relations.split_by(orders, orders.where("o_orderkey % 40 = 0").select("fingerprint").distinct(), ["fingerprint"])
    return new.select("o_orderkey")


@query("SELECT p_partkey, lower(hex(CAST(list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split(p_name, ''), lambda c: ascii(c)::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS UBIGINT))) AS fingerprint FROM part")
def q_fnv1a_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select("p_partkey", hashing.fnv1a64_hex(F.col("p_name")).alias("fingerprint"))


@query("SELECT coalesce(a.doc_id, b.doc_id) AS path, CASE WHEN b.doc_id IS NULL THEN 'pruned' WHEN a.t = b.t THEN 'hit' ELSE 'miss' END AS state FROM (SELECT doc_id, text AS t FROM documents WHERE doc_id % 11 <> 0) a FULL JOIN (SELECT doc_id, text || CASE WHEN doc_id % 7 = 0 THEN '!' ELSE '' END AS t FROM documents WHERE doc_id % 13 <> 0) b USING (doc_id) WHERE coalesce(a.doc_id, b.doc_id) IS NOT NULL")
def q_cache_merge(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("path"), "text")
    old = docs.where("path % 11 <> 0").select("path", hashing.content_fingerprint(F.col("text")).alias("fingerprint"))
    edited = F.concat("text", F.when(F.col("path") % 7 == 0, "!").otherwise(""))
    return relations.cache_plan(old, docs.where("path % 13 <> 0").select("path", hashing.content_fingerprint(edited).alias("fingerprint")))


@query(f"WITH {_LINES}, m AS (SELECT p.event_id AS id, c.event_id AS other, abs(p.line - c.line) AS distance, c.line AS cline FROM lines p JOIN lines c ON p.file = c.file AND abs(p.line - c.line) <= 5 WHERE p.event_type = 'purchase' AND c.event_type = 'click') SELECT id, other, CAST(distance AS INTEGER) AS distance FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, cline, other) = 1")
def q_nearest_line(spark: SparkSession, d: str) -> DataFrame:
    lines = event_lines(spark, d)
    left = lines.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), F.col("file").alias("key"), "line")
    return relations.nearest(left, lines.where("event_type = 'click'").select(F.col("event_id").alias("other"), F.col("file").alias("key"), F.col("line").alias("at")), 5)


@query("SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned, count(DISTINCT l_partkey) AS n_parts, bool_and(l_linestatus = 'O') AS only_open FROM lineitem GROUP BY 1")
def q_usage_counts(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("n_returned"), F.countDistinct("l_partkey").alias("n_parts"), F.bool_and(F.col("l_linestatus") == "O").alias("only_open"))


@query("SELECT DISTINCT a.p_partkey AS requirement, b.p_partkey AS member FROM part a JOIN lineitem ON l_partkey = a.p_partkey JOIN part b ON b.p_brand = a.p_brand AND b.p_size = l_suppkey % 50 WHERE a.p_size = 7")
def q_protocol_witness(spark: SparkSession, d: str) -> DataFrame:
    part, items = _t(spark, d, "part"), _t(spark, d, "lineitem")
    requirements = part.where("p_size = 7").select(F.col("p_partkey").alias("requirement"), F.col("p_partkey").alias("protocol"), F.col("p_brand").alias("name"))
    conformances = items.select(F.col("l_partkey").alias("protocol"), (F.col("l_suppkey") % 50).cast("int").alias("type")).distinct()
    return relations.witnesses(requirements, part.select(F.col("p_partkey").alias("member"), F.col("p_size").alias("type"), F.col("p_brand").alias("name")), conformances)


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 300000 UNION SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000) UNION SELECT l_orderkey FROM lineitem WHERE l_quantity = 50")
def q_forced_set(spark: SparkSession, d: str) -> DataFrame:
    orders = _t(spark, d, "orders")
    rich = _t(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"))
    parts = [orders.where("o_totalprice > 300000").select("o_orderkey"), orders.join(rich, "o_custkey", "left_semi").select("o_orderkey"), _t(spark, d, "lineitem").where("l_quantity = 50").select(F.col("l_orderkey").alias("o_orderkey"))]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


_SYMBOL_PATH = "'src/' || ({} % 3) || '.swift'"
_USE_PATH = f"CASE WHEN l_partkey % 50 = 0 THEN 'Tests/x.swift' ELSE {_SYMBOL_PATH.format('l_suppkey')} END"


@query(f"""WITH u AS (SELECT l_suppkey AS usr, {_USE_PATH} AS path FROM lineitem WHERE l_linenumber > 1)
SELECT s_suppkey AS usr, count(path) AS n_references, count(*) FILTER (WHERE path <> {_SYMBOL_PATH.format("s_suppkey")}) = 0 AS self_only, coalesce(bool_or(starts_with(path, 'Tests/')), false) AS in_tests FROM supplier LEFT JOIN u ON usr = s_suppkey GROUP BY s_suppkey""")
def q_symbol_usage(spark: SparkSession, d: str) -> DataFrame:
    symbols = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("usr"), _key("f", "s_suppkey").alias("name"), F.expr(_SYMBOL_PATH.format("s_suppkey")).alias("path"))
    occurrences = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("usr"), F.expr(_USE_PATH).alias("path"), F.expr("CASE l_linenumber WHEN 1 THEN 'definition' ELSE 'call' END").alias("role"))
    return index_oracle.usage(symbols, occurrences).drop("name")


@query("SELECT p_partkey AS decl FROM part WHERE p_size = 13 OR p_partkey % 3 = 1 OR (p_partkey % 3 = 0 AND p_size * 7 % 50 IN (SELECT p_size FROM part WHERE p_size % 10 = 0))")
def q_index_forced(spark: SparkSession, d: str) -> DataFrame:
    kind = F.expr("CASE WHEN p_size % 10 = 0 THEN 'protocol' ELSE 'function' END").alias("kind")
    within = F.expr("CASE p_partkey % 3 WHEN 0 THEN 'extension' WHEN 1 THEN 'protocol' END").alias("enclosing_kind")
    decls = _t(spark, d, "part").select(F.col("p_partkey").alias("decl"), kind, F.col("p_size").alias("name"), within, (F.col("p_size") * 7 % 50).alias("enclosing_type"), (F.col("p_size") == 13).alias("local"))
    return index_oracle.forced(decls)


def generated_sources(spark: SparkSession, d: str) -> DataFrame:
    """A source per part: a function that may call the next part's; an entry type and accepting comments in some."""
    k = F.col("p_partkey")
    calls = F.when((k + 1) % 5 != 0, F.concat(F.lit("f"), (k + 1).cast("string"), F.lit("()"))).otherwise("")
    entry = F.when(k % 10 == 0, F.concat(F.lit("@main struct M"), k.cast("string"), F.lit(" {\n    static func main() { f"), k.cast("string"), F.lit("() }\n}\n"))).otherwise("")
    accept = F.when(k % 10 == 7, "// @tr:accept unused-function -- kept\n").otherwise("")
    source = F.concat(accept, F.lit("func f"), k.cast("string"), F.lit("() { "), calls, F.lit(" }\n"), entry)
    return _t(spark, d, "part").select(F.concat(F.lit("src/p"), k.cast("string"), F.lit(".swift")).alias("path"), source.alias("source"), F.lit(None).cast("string").alias("error"))


_ANALYZED = """SELECT 'unused-function' AS rule, 'src/p' || p_partkey || '.swift' AS path, CASE p_partkey % 10 WHEN 7 THEN 2 ELSE 1 END AS line, 'medium' AS confidence, p_partkey % 10 = 7 AS suppressed FROM part
WHERE p_partkey % 10 >= 5 OR p_partkey - p_partkey % 10 NOT IN (SELECT p_partkey FROM part)"""


@query(_ANALYZED)
def q_analyze(spark: SparkSession, d: str) -> DataFrame:
    report = analysis.analyze(spark, generated_sources(spark, d))
    rows = lambda df, gone: df.select("rule", "path", F.col("line").cast("int"), "confidence", F.lit(gone).alias("suppressed"))
    return rows(report.findings, False).unionByName(rows(report.suppressed, True))


@query("""WITH found AS (SELECT p_partkey AS k, 'func f' || p_partkey || '() { ' || CASE WHEN (p_partkey + 1) % 5 <> 0 THEN 'f' || (p_partkey + 1) || '()' ELSE '' END || ' }' AS snippet FROM part
  WHERE p_partkey % 10 <> 7 AND (p_partkey % 10 >= 5 OR p_partkey - p_partkey % 10 NOT IN (SELECT p_partkey FROM part))),
g AS (SELECT k, unnest(list_transform(generate_series(1, length(snippet) - 2), lambda i: substr(snippet, i, 3))) AS gram FROM found),
h AS (SELECT gram, CAST(list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(regexp_extract_all(hex(encode(gram)), '..'), lambda x: CAST('0x' || x AS BIGINT)::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) % 128 AS INTEGER) AS bucket FROM (SELECT DISTINCT gram FROM g)),
n AS (SELECT k, bucket, count(*)::DOUBLE AS n FROM g JOIN h USING (gram) GROUP BY 1, 2),
m AS (SELECT k, map(list(bucket), list(n)) AS m FROM n GROUP BY 1),
v AS (SELECT k, list_transform(generate_series(0, 127), lambda i: coalesce(m[i::INTEGER], 0.0)) AS e FROM m),
p AS (SELECT a.k, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.k <> b.k),
t AS (SELECT k, s FROM p QUALIFY row_number() OVER (PARTITION BY k ORDER BY s DESC) <= 5)
SELECT 'src/p' || k || '.swift' AS path, 'confidence medium; embedding-confidence: ' || CAST(round(greatest(0, least(1, 1 - avg(s))) * 100) AS INTEGER) || '% anomaly [experimental, character n-grams]' AS note FROM t GROUP BY k""")
def q_similarity_notes(spark: SparkSession, d: str) -> DataFrame:
    report = analysis.analyze(spark, generated_sources(spark, d), analysis.Configuration(similarity="exact"))
    return report.findings.select("path", "note")


def generated_index(spark: SparkSession, d: str) -> index_oracle.Index:
    """An index of the generated sources: it knows fewer calls than names suggest, and every seventh function not at all."""
    k = F.col("p_partkey")
    text_ = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    path, own = text_("src/p", k, ".swift"), _t(spark, d, "part")
    line = F.when(k % 10 == 7, 2).otherwise(1)
    functions = own.where(k % 7 != 3).select(text_("f", k).alias("usr"), text_("f", k, "()").alias("name"), F.lit("function").alias("kind"), path.alias("path"), line.alias("line"))
    mains = own.where(k % 10 == 0).select(text_("m", k).alias("usr"), F.lit("main()").alias("name"), F.lit("function").alias("kind"), path.alias("path"), F.lit(3).alias("line"))
    types = own.where(k % 10 == 0).select(text_("t", k).alias("usr"), text_("M", k).alias("name"), F.lit("struct").alias("kind"), path.alias("path"), F.lit(2).alias("line"))
    use = lambda df, used, user: df.select(used.alias("usr"), path.alias("path"), line.alias("line"), F.lit("call").alias("role"), F.lit("containedBy").alias("relation"), user.alias("related"))
    calls = use(own.where(((k + 1) % 5 != 0) & (k % 3 != 0)), text_("f", k + 1), text_("f", k))
    return index_oracle.Index(functions.unionByName(mains).unionByName(types), calls.unionByName(use(own.where(k % 10 == 0), text_("f", k), text_("m", k))))


_BY_NAMES = "p_partkey % 10 >= 5 OR p_partkey - p_partkey % 10 NOT IN (SELECT p_partkey FROM part)"
_BY_INDEX = f"({_BY_NAMES} OR EXISTS (SELECT 1 FROM range(p_partkey % 10) r(i) WHERE (p_partkey - p_partkey % 10 + i) % 3 = 0))"
_FOUND = "SELECT 'unused-function' AS rule, 'src/p' || p_partkey || '.swift' AS path, CASE p_partkey % 10 WHEN 7 THEN 2 ELSE 1 END AS line, p_partkey % 10 = 7 AS suppressed FROM part"


def _analyzed_by_index(spark: SparkSession, d: str, unmapped: str) -> DataFrame:
    report = analysis.analyze(spark, generated_sources(spark, d), analysis.Configuration(unmapped=unmapped), generated_index(spark, d))
    rows = lambda df, gone: df.select("rule", "path", F.col("line").cast("int"), F.lit(gone).alias("suppressed"))
    return rows(report.findings, False).unionByName(rows(report.suppressed, True))


@query(f"{_FOUND} WHERE p_partkey % 7 <> 3 AND {_BY_INDEX}")
def q_index_analyze(spark: SparkSession, d: str) -> DataFrame:
    return _analyzed_by_index(spark, d, "reached")


@query(f"{_FOUND} WHERE CASE WHEN p_partkey % 7 <> 3 THEN {_BY_INDEX} ELSE {_BY_NAMES} END")
def q_index_partial(spark: SparkSession, d: str) -> DataFrame:
    return _analyzed_by_index(spark, d, "syntax")


# Four parts are a file: an extension, a type and a member of each; names of types repeat where the table is large.
_DECLARED = """decls AS (SELECT p_partkey AS decl, p_partkey // 4 AS file, p_partkey % 4 AS place, p_size % 6 AS own,
  'T' || (CASE WHEN p_partkey % 4 = 0 THEN p_partkey * 7 + 1 ELSE p_partkey END % 401) AS name, 'T' || (p_partkey * 11 % 401) AS base,
  p_size % 9 = 0 AS suite, p_size % 5 = 0 AS derived FROM part)"""


def declared(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("p_partkey"), lambda x: F.concat(F.lit("T"), (x % 401).cast("string"))
    kind = F.when(k % 4 == 0, "extension").when(k % 4 == 1, "class").otherwise("method")
    access = F.array(*map(F.lit, analysis.RANK))[(F.col("p_size") % 6).cast("int")]
    holder = F.when(k % 4 >= 2, F.array((k - 2).cast("int"))).otherwise(F.array().cast("array<int>"))
    base = F.when(F.col("p_size") % 5 == 0, F.when(k % 3 == 0, "XCTestCase").otherwise(n(k * 11)))
    types = k % 4 < 2
    return _t(spark, d, "part").select(
        k.alias("decl"), F.concat(F.lit("src/p"), F.floor(k / 4).cast("string"), F.lit(".swift")).alias("path"), k.cast("int").alias("ordinal"), n(F.when(k % 4 == 0, k * 7 + 1).otherwise(k)).alias("name"), kind.alias("kind"),
        access.alias("access"), holder.alias("enclosing"), F.when(types & base.isNotNull(), F.array(base)).otherwise(F.array().cast("array<string>")).alias("conformances"),
        F.when(types & (F.col("p_size") % 9 == 0), F.array(F.lit("Suite"))).otherwise(F.array().cast("array<string>")).alias("attributes"),
    )


@query(f"""WITH {_DECLARED}, types AS (SELECT name, min(own) AS extended FROM decls WHERE place = 1 GROUP BY name HAVING count(*) = 1),
above AS (SELECT d.decl, CASE WHEN place = 0 THEN greatest(own, coalesce(extended, 2)) ELSE own END AS above FROM decls d LEFT JOIN types USING (name) WHERE place < 2)
SELECT d.decl, least(own, coalesce(above, own)) AS effective FROM decls d LEFT JOIN above a ON d.place >= 2 AND a.decl = d.decl - 2""")
def q_extension_access(spark: SparkSession, d: str) -> DataFrame:
    return analysis.with_effective_access(declared(spark, d)).select("decl", "effective")


@query(f"""WITH RECURSIVE {_DECLARED}, bases AS (SELECT name, CASE WHEN decl % 3 = 0 THEN 'XCTestCase' ELSE base END AS base FROM decls WHERE place < 2 AND derived),
descends(name) AS (SELECT 'XCTestCase' UNION SELECT b.name FROM descends x JOIN bases b ON b.base = x.name),
holds AS (SELECT decl FROM decls WHERE place < 2 AND (suite OR name IN (SELECT name FROM descends)))
SELECT d.decl FROM decls d JOIN holds h ON h.decl = CASE WHEN d.place >= 2 THEN d.decl - 2 ELSE d.decl END""")
def q_test_containers(spark: SparkSession, d: str) -> DataFrame:
    return analysis.with_test_scope(declared(spark, d)).where("in_tests").select("decl")


@query("""SELECT 'src/' || o_custkey || '.swift:' || o_orderkey || ':' || o_orderkey % 80 || ': ' || CASE o_orderstatus WHEN 'F' THEN 'error' ELSE 'warning' END || ': [unused-' || lower(o_orderpriority[3:]) || '] total ' || o_orderkey
|| CASE WHEN o_orderstatus = 'P' THEN '' ELSE ' — status ' || o_orderstatus END AS line FROM orders""")
def q_report_lines(spark: SparkSession, d: str) -> DataFrame:
    text_ = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    rows = _t(spark, d, "orders").select(
        text_("src/", F.col("o_custkey"), ".swift").alias("path"), key.alias("line"), (key % 80).alias("column"), F.when(status == "F", "error").otherwise("warning").alias("severity"),
        text_("unused-", F.lower(F.substring("o_orderpriority", 3, 99))).alias("rule"), text_("total ", key).alias("message"), F.when(status != "P", text_("status ", status)).alias("note"),
    )
    return rows.select(sinks.text_line().alias("line"))


@query("SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS errors, count(*) FILTER (WHERE o_orderstatus = 'O') AS warnings, count(DISTINCT o_custkey) AS files, max(CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END) AS max_severity FROM orders")
def q_summary(spark: SparkSession, d: str) -> DataFrame:
    severity = F.when(F.col("o_orderstatus") == "F", "error").when(F.col("o_orderstatus") == "O", "warning")
    return policy.summary(_t(spark, d, "orders"), severity, F.col("o_custkey"))


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderstatus, o_orderkey) AS place FROM orders")
def q_total_order(spark: SparkSession, d: str) -> DataFrame:
    return dataflow.in_order(_t(spark, d, "orders"), "o_custkey", ["o_orderpriority", "o_orderstatus", "o_orderkey"]).select("o_orderkey", F.col("pos").alias("place"))


_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_STATEMENTS = f"stmts AS (SELECT l_orderkey AS fn, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_ORDER)}) AS pos, l_partkey % 4 AS def, l_suppkey % 4 AS use FROM lineitem)"
_FLOW = "flow AS (SELECT fn, pos AS src, pos + 1 AS dst FROM stmts s WHERE pos < (SELECT max(pos) FROM stmts m WHERE m.fn = s.fn) UNION SELECT fn, max(pos), 1 FROM stmts GROUP BY fn)"


def _statements(spark: SparkSession, d: str) -> DataFrame:
    rows = dataflow.in_order(_t(spark, d, "lineitem"), "l_orderkey", _ORDER)
    return rows.select(F.col("l_orderkey").alias("fn"), "pos", (F.col("l_partkey") % 4).alias("def"), (F.col("l_suppkey") % 4).alias("use"))


def _flow(statements: DataFrame) -> DataFrame:
    """Each statement to the next, and the last back to the first."""
    following = F.coalesce(F.lead("pos").over(Window.partitionBy("fn").orderBy("pos")), F.lit(1))
    return statements.select("fn", F.col("pos").alias("src"), following.alias("dst"))


@query(f"WITH {_STATEMENTS}, u AS (SELECT fn, use AS var, min(pos) AS first_use FROM stmts GROUP BY 1, 2), d AS (SELECT fn, def AS var, min(pos) AS first_def FROM stmts GROUP BY 1, 2) SELECT fn, var, first_use FROM u LEFT JOIN d USING (fn, var) WHERE first_def IS NULL OR first_use <= first_def")
def q_use_def_exposed(spark: SparkSession, d: str) -> DataFrame:
    return dataflow.exposed_uses(_statements(spark, d))


@query(f"WITH RECURSIVE {_STATEMENTS}, {_FLOW}, live(fn, pos, var) AS (SELECT fn, pos, use FROM stmts UNION SELECT f.fn, f.src, l.var FROM live l JOIN flow f ON f.fn = l.fn AND f.dst = l.pos JOIN stmts s ON s.fn = f.fn AND s.pos = f.src WHERE s.def <> l.var) SELECT s.fn, s.pos, s.def AS var FROM stmts s WHERE s.def <> s.use AND NOT EXISTS (SELECT 1 FROM flow f JOIN live l ON l.fn = f.fn AND l.pos = f.dst WHERE f.fn = s.fn AND f.src = s.pos AND l.var = s.def)")
def q_liveness(spark: SparkSession, d: str) -> DataFrame:
    statements = _statements(spark, d)
    flow = _flow(statements)
    return dataflow.dead_stores(statements, flow, dataflow.live_in(statements, flow))


@query(f"WITH RECURSIVE {_STATEMENTS}, {_FLOW}, r(fn, pos, var, def_at) AS (SELECT s.fn, f.dst, s.def, s.pos FROM stmts s JOIN flow f ON f.fn = s.fn AND f.src = s.pos UNION SELECT r.fn, f.dst, r.var, r.def_at FROM r JOIN stmts s ON s.fn = r.fn AND s.pos = r.pos JOIN flow f ON f.fn = s.fn AND f.src = s.pos WHERE s.def <> r.var) SELECT fn, pos, count(*) AS n_reaching FROM r GROUP BY 1, 2")
def q_reaching_defs(spark: SparkSession, d: str) -> DataFrame:
    statements = _statements(spark, d)
    return dataflow.reaching(statements, _flow(statements)).groupBy("fn", "pos").agg(F.count("*").alias("n_reaching"))


# Bodies that end: each statement leads to the next, some also over it, some back; the last one is the exit.
_BODY = f"""{_STATEMENTS},
lasts AS (SELECT fn, max(pos) AS n FROM stmts GROUP BY fn),
body AS (SELECT fn, pos AS src, pos + 1 AS dst FROM stmts JOIN lasts USING (fn) WHERE pos < n
  UNION SELECT fn, pos, pos + 2 FROM stmts JOIN lasts USING (fn) WHERE pos + 2 <= n AND def = 1
  UNION SELECT fn, pos, pos - 1 FROM stmts WHERE pos > 1 AND use = 3)"""
_REACHING = """reach(fn, pos, var, def_at) AS (SELECT s.fn, f.dst, s.def, s.pos FROM stmts s JOIN body f ON f.fn = s.fn AND f.src = s.pos
  UNION SELECT r.fn, f.dst, r.var, r.def_at FROM reach r JOIN stmts s ON s.fn = r.fn AND s.pos = r.pos JOIN body f ON f.fn = s.fn AND f.src = s.pos WHERE s.def <> r.var)"""
_OPEN = """open(fn, pos, var) AS (SELECT DISTINCT fn, 1::BIGINT, use FROM stmts
  UNION SELECT o.fn, f.dst, o.var FROM open o JOIN stmts s ON s.fn = o.fn AND s.pos = o.pos JOIN body f ON f.fn = s.fn AND f.src = s.pos WHERE s.def <> o.var)"""
_LIVE = """live(fn, pos, var) AS (SELECT fn, pos, use FROM stmts
  UNION SELECT f.fn, f.src, l.var FROM live l JOIN body f ON f.fn = l.fn AND f.dst = l.pos JOIN stmts s ON s.fn = f.fn AND s.pos = f.src WHERE s.def <> l.var)"""


def _bodies(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(statements, flow, exits)."""
    statements = _statements(spark, d)
    n = F.max("pos").over(Window.partitionBy("fn"))
    placed = statements.withColumn("n", n)
    on = F.when(F.col("pos") < F.col("n"), F.col("pos") + 1)
    over = F.when((F.col("pos") + 2 <= F.col("n")) & (F.col("def") == 1), F.col("pos") + 2)
    back = F.when((F.col("pos") > 1) & (F.col("use") == 3), F.col("pos") - 1)
    flow = placed.select("fn", F.col("pos").alias("src"), F.explode(F.array_distinct(F.array(on, over, back))).alias("dst")).where("dst IS NOT NULL")
    return statements, flow, placed.where("pos = n").select("fn", "pos")


@query(f"WITH RECURSIVE {_BODY}, {_REACHING} SELECT s.fn, s.pos, s.use AS var, r.def_at AS at FROM stmts s JOIN reach r ON r.fn = s.fn AND r.pos = s.pos AND r.var = s.use")
def q_def_use(spark: SparkSession, d: str) -> DataFrame:
    statements, flow, _ = _bodies(spark, d)
    return dataflow.def_use(statements, flow)


@query(f"""WITH RECURSIVE {_BODY}, {_REACHING}, {_OPEN}
SELECT s.fn, s.pos, s.use AS var, NOT EXISTS (SELECT 1 FROM reach r WHERE r.fn = s.fn AND r.pos = s.pos AND r.var = s.use) AS never
FROM stmts s JOIN open o ON o.fn = s.fn AND o.pos = s.pos AND o.var = s.use""")
def q_uninitialised(spark: SparkSession, d: str) -> DataFrame:
    statements, flow, _ = _bodies(spark, d)
    entries = statements.where("pos = 1").select("fn", "pos")
    return dataflow.uninitialised(statements, flow, entries, dataflow.def_use(statements, flow))


@query(f"""WITH RECURSIVE {_BODY}, {_REACHING}, {_LIVE}
SELECT s.fn, s.pos, s.def AS var FROM stmts s JOIN lasts l USING (fn)
WHERE s.def <> s.use AND s.pos <> l.n
  AND NOT EXISTS (SELECT 1 FROM body f JOIN live v ON v.fn = f.fn AND v.pos = f.dst WHERE f.fn = s.fn AND f.src = s.pos AND v.var = s.def)
  AND NOT EXISTS (SELECT 1 FROM reach r JOIN stmts e ON e.fn = r.fn AND e.pos = r.pos
    WHERE r.fn = s.fn AND r.pos = l.n AND r.var = s.def AND r.def_at = s.pos AND e.def <> r.var)""")
def q_dead_stores(spark: SparkSession, d: str) -> DataFrame:
    statements, flow, exits = _bodies(spark, d)
    live, reaching = dataflow.live_in(statements, flow), dataflow.reaching(statements, flow)
    return dataflow.overwritten_stores(statements, flow, exits, live, reaching)


# Blocks of one step each: literals, sums, products, copies and calls set one of four variables, and every other block ends in a test.
_STEPS = f"""placed AS (SELECT l_orderkey AS fn, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_ORDER)}) AS pos,
    count(*) OVER (PARTITION BY l_orderkey) AS n, 'v' || (l_partkey % 4) AS target, l_suppkey % 6 AS kind, l_linenumber AS k, (l_partkey + l_suppkey) % 2 = 0 AS tested FROM lineitem),
steps AS (SELECT *, CASE kind WHEN 2 THEN '+' WHEN 3 THEN '*' WHEN 5 THEN 'call' END AS op, CASE WHEN kind IN (2, 3, 4) THEN 'v' || (k % 4) END AS lv,
    CASE WHEN kind < 2 THEN (k % 3)::VARCHAR END AS l, CASE WHEN kind = 3 THEN 'v' || ((k + 1) % 4) END AS rv, CASE WHEN kind = 2 THEN '1' END AS r,
    'v' || ((k + 2) % 4) AS cv, CASE WHEN pos < n THEN pos + 1 ELSE 0 END AS next, CASE WHEN k % 2 = 0 THEN pos * 3 % n + 1 ELSE least(pos + 2, n) END AS other FROM placed)"""


def _folded_sql(op: str, a: str, b: str) -> str:
    number = f"CASE {op} WHEN '+' THEN ({a}::BIGINT + {b}::BIGINT)::VARCHAR WHEN '*' THEN ({a}::BIGINT * {b}::BIGINT)::VARCHAR WHEN '<' THEN ({a}::BIGINT < {b}::BIGINT)::VARCHAR END"
    return f"CASE WHEN {op} = 'call' THEN '?' WHEN {a} IS NULL OR {op} IS NOT NULL AND {b} IS NULL THEN NULL WHEN {op} IS NULL THEN {a} WHEN {a} = '?' OR {b} = '?' THEN '?' ELSE {number} END"


def _fixpoint_sql() -> str:
    """A row per function and round: values v0 to v3 and the executable ways (src * 1000 + dst); all steps of a function are taken at once."""
    of = lambda c: f"CASE {c} WHEN 'v0' THEN v0 WHEN 'v1' THEN v1 WHEN 'v2' THEN v2 WHEN 'v3' THEN v3 END"
    low = lambda i: f"least(any_value(v{i}), min(val) FILTER (target = 'v{i}'))"
    high = lambda i: f"greatest(any_value(v{i}), max(val) FILTER (target = 'v{i}'))"
    met = ", ".join(f"CASE WHEN {low(i)} = {high(i)} AND {low(i)} <> '?' THEN {low(i)} WHEN {low(i)} IS NOT NULL THEN '?' END AS n{i}" for i in range(4))
    same = " AND ".join([*(f"n{i} IS NOT DISTINCT FROM o{i}" for i in range(4)), "new_ways = ways"])
    return f"""{_STEPS},
state(fn, round, settled, v0, v1, v2, v3, ways) AS (
  SELECT DISTINCT fn, 0, false, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, []::BIGINT[] FROM steps
  UNION ALL
  SELECT fn, round + 1, {same}, n0, n1, n2, n3, new_ways FROM (
    SELECT fn, any_value(round) AS round, any_value(settled) AS settled, {", ".join(f"any_value(v{i}) AS o{i}" for i in range(4))}, any_value(ways) AS ways, {met},
      list_sort(list_distinct(list_concat(any_value(ways), coalesce(list(pos * 1000 + next) FILTER (NOT tested OR said IN ('true', '?')), []),
        coalesce(list(pos * 1000 + other) FILTER (tested AND said IN ('false', '?')), [])))) AS new_ways
    FROM (SELECT *, {_folded_sql("op", "a", "b")} AS val, coalesce({_folded_sql("'<'", "c", "'2'")}, CASE WHEN settled THEN '?' END) AS said
      FROM (SELECT s.*, t.pos, t.n, t.target, t.op, t.tested, t.next, t.other, CASE WHEN t.lv IS NULL THEN t.l ELSE {of("t.lv")} END AS a,
          CASE WHEN t.rv IS NULL THEN t.r ELSE {of("t.rv")} END AS b, {of("t.cv")} AS c
        FROM state s JOIN steps t ON t.fn = s.fn AND (t.pos = 1 OR list_contains(list_transform(s.ways, lambda w: w % 1000), t.pos))))
    GROUP BY fn) WHERE NOT (settled AND {same})),
final AS (SELECT * FROM state QUALIFY row_number() OVER (PARTITION BY fn ORDER BY round DESC) = 1),
ways AS (SELECT fn, way // 1000 AS src, way % 1000 AS dst FROM (SELECT fn, unnest(ways) AS way FROM final)),
known AS (SELECT fn, unnest(['v0', 'v1', 'v2', 'v3']) AS name, unnest([v0, v1, v2, v3]) AS value FROM final)"""


_FIXPOINT = _fixpoint_sql()


def _steps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(flow, steps) of `constants`."""
    c, text = F.col, lambda x: x.cast("string")
    variable = lambda by: F.concat(F.lit("v"), text((c("l_linenumber") + by) % 4))
    placed = dataflow.in_order(_t(spark, d, "lineitem"), "l_orderkey", _ORDER).withColumn("n", F.count("*").over(Window.partitionBy("l_orderkey")))
    kind = c("l_suppkey") % 6
    own = placed.select(
        c("l_orderkey").alias("fn"), c("pos").alias("block"), "n", c("l_linenumber").alias("k"), F.concat(F.lit("v"), text(c("l_partkey") % 4)).alias("target"),
        F.when(kind == 2, "+").when(kind == 3, "*").when(kind == 5, "call").alias("op"), F.when(kind.isin(2, 3, 4), variable(0)).alias("left_var"),
        F.when(kind < 2, text(c("l_linenumber") % 3)).alias("left"), F.when(kind == 3, variable(1)).alias("right_var"), F.when(kind == 2, "1").alias("right"),
        variable(2).alias("tested_var"), ((c("l_partkey") + c("l_suppkey")) % 2 == 0).alias("tested"),
    )
    null, false = F.lit(None).cast("string"), F.lit(False).alias("loop")
    tests = own.where("tested").select("fn", "block", null.alias("target"), F.lit("<").alias("op"), c("tested_var").alias("left_var"), null.alias("left"), null.alias("right_var"), F.lit("2").alias("right"), false)
    steps = own.select("fn", "block", "target", *constants.OPERANDS, false).unionByName(tests)
    on = F.when(c("block") < c("n"), c("block") + 1).otherwise(0)
    other = F.when(c("k") % 2 == 0, c("block") * 3 % c("n") + 1).otherwise(F.least(c("block") + 2, c("n")))
    ways = F.when(c("tested"), F.array(F.struct(on.alias("dst"), F.lit("true").alias("side")), F.struct(other.alias("dst"), F.lit("false").alias("side")))).otherwise(F.array(F.struct(on.alias("dst"), null.alias("side"))))
    inner = own.select("fn", c("block").alias("src"), F.explode(ways).alias("w")).select("fn", "src", "w.*")
    entry = own.where("block = 1").select("fn", F.lit(None).cast("long").alias("src"), F.lit(1).cast("long").alias("dst"), null.alias("side"))
    return inner.unionByName(entry), steps


@query(f"WITH RECURSIVE {_FIXPOINT} SELECT fn, src, dst FROM ways")
def q_sccp_edges(spark: SparkSession, d: str) -> DataFrame:
    return constants.executable_edges(constants.propagated(*_steps(spark, d)))


@query(f"WITH RECURSIVE {_FIXPOINT} SELECT fn, name, value FROM known WHERE value IS NOT NULL")
def q_sccp_values(spark: SparkSession, d: str) -> DataFrame:
    return constants.values(constants.propagated(*_steps(spark, d)))


@query(f"""WITH RECURSIVE {_FIXPOINT},
dead AS (SELECT t.fn, t.pos, t.next, t.other, (k.value::BIGINT < 2)::VARCHAR AS value FROM steps t JOIN known k ON k.fn = t.fn AND k.name = t.cv
  WHERE t.tested AND k.value <> '?' AND (t.pos = 1 OR EXISTS (SELECT 1 FROM ways w WHERE w.fn = t.fn AND w.dst = t.pos)))
SELECT fn, pos AS block, CASE value WHEN 'true' THEN 'false' ELSE 'true' END AS side, value FROM dead d
WHERE NOT EXISTS (SELECT 1 FROM ways w WHERE w.fn = d.fn AND w.src = d.pos AND w.dst = CASE value WHEN 'true' THEN d.other ELSE d.next END)""")
def q_dead_branches(spark: SparkSession, d: str) -> DataFrame:
    flow, steps = _steps(spark, d)
    return constants.dead_branches(flow, steps, constants.propagated(flow, steps))


@query("SELECT l_partkey, CASE WHEN min(l_discount) = max(l_discount) THEN min(l_discount) END AS constant FROM lineitem GROUP BY 1")
def q_sccp_meet(spark: SparkSession, d: str) -> DataFrame:
    return dataflow.meet(_t(spark, d, "lineitem"), "l_partkey", "l_discount")


@query("""WITH g AS (SELECT item_id, unnest(list_transform(generate_series(1, length(text) - 2), lambda i: substr(text, i, 3))) AS gram FROM benchmark WHERE length(text) >= 3),
d AS (SELECT gram, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(regexp_extract_all(hex(encode(gram)), '..'), lambda x: CAST('0x' || x AS BIGINT)::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS h FROM (SELECT DISTINCT gram FROM g))
SELECT item_id, CAST(h % 128 AS INTEGER) AS bucket, count(*) AS n FROM g JOIN d USING (gram) GROUP BY 1, 2""")
def q_ngram_embed(spark: SparkSession, d: str) -> DataFrame:
    return similarity.gram_counts(_t(spark, d, "benchmark"), "text", "item_id")


@query("WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), p AS (SELECT a.vec_id AS id, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id), t AS (SELECT id, s FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC) <= 5) SELECT id, round(greatest(0, least(1, 1 - avg(s))), 4) AS anomaly FROM t GROUP BY 1")
def q_knn_outlier(spark: SparkSession, d: str) -> DataFrame:
    return similarity.anomaly(_t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))).select("id", F.round("anomaly", 4).alias("anomaly"))


@query(ORACLE_SQL["q_knn_outlier"])
def q_knn_index(spark: SparkSession, d: str) -> DataFrame:
    """The same by the inverted file, with all of eight cells asked."""
    near = similarity.neighbours(_t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), cells=8, probes=8)
    mean = F.aggregate("near", F.lit(0.0), lambda a, x: a + x["similarity"]) / F.greatest(F.size("near"), F.lit(1))
    return near.select("id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - mean)), 4).alias("anomaly"))


def synthetic_vocabulary() -> dict[str, int]:
    """Special tokens, every letter, digit and mark, and frequent pairs of letters, each at a word's start and within."""
    letters = "abcdefghijklmnopqrstuvwxyz0123456789.,;:!?'\"()-"
    pairs = [a + b for a in "abcdefghilmnoprstuw" for b in "aeionrst"]
    return {t: i for i, t in enumerate(dict.fromkeys(["[PAD]", "[UNK]", "[CLS]", "[SEP]", *letters, *("##" + c for c in letters), *pairs, *("##" + p for p in pairs)]))}


@query()
def q_wordpiece(spark: SparkSession, d: str) -> DataFrame:
    turns = _t(spark, d, "conversations").withColumn("key", F.concat_ws(":", "conv_id", "turn"))
    return similarity.wordpiece(turns, "text", "key", synthetic_vocabulary())
