"""URL filter: host and path rules, then trust and distrust spread over the graph of hosts.

Seeds are the rules' own verdicts: a host is trusted by the share of its pages that rules allow, and distrusted by the
share that they block. Trust is a personalised PageRank from the trusted seeds along links; distrust is one from the
blocked seeds along reversed links, so that hosts that link to blocked ones take some of it. Beside each goes the
PageRank with a uniform teleport on the same graph, and a host's trust (distrust) is the part of that which comes from
the seeds: between 0 and 1 whatever the graph's cycles hold, and a seed's own share where a host has no link. A host is
blocked if its distrust is more than its trust, and more than `LIFT` times the mean of all hosts': in a graph whose links say nothing
about blocking every host's distrust comes to that mean, so what lies above it is nearer to blocked hosts than by chance.
Ranks move until no host's changes by more than the tolerance; if that takes more than `ROUNDS` rounds an error is raised. The mass of hosts without links ends there.

Edges, aggregated by pair of hosts and weighted by the share of the source's: hosts' absolute and protocol-relative
`<a href>` links, and one from each host to its parent domain and back, from there to the next one, and so on (x.www.a.org, www.a.org
and a.org; not to a top level, not for addresses), so hosts of one domain reach each other whether or not what lies between has pages. A host's links to itself are left out. Each round joins ranks and links by host; links of a host with very
many are split in parts, so no host is one task's work.

A null or malformed url has an empty host and path; no rule fits it, and it is judged as a host without pages: allowed.
A null html has no links; very long ones are read whole. Repeated rows count as pages of their own. Of rules of one
length that fit (ties) the last in order of host and path counts. An empty table gives an empty table. Extra columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taproot.llm import common

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DAMPING, ROUNDS, TOLERANCE, LIFT = 0.85, 300, 1e-4, 1.0
#: Rounds between two stored states; links of a host in one part.
STRIDE, PART = 10, 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lowered; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, then in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(then)).otherwise(verdict)
    return rule, verdict


def domains_of(host: Column) -> Column:
    """Pairs (src, dst) of a host and the domain above it, and of that and the next, down to two labels; none for addresses."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffix = lambda i: F.array_join(F.slice(labels, i + 1, n - i), ".")
    pairs = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(suffix(i).alias("src"), suffix(i + 1).alias("dst")))
    return F.when((n >= 3) & ~host.rlike(r"^[\d.:\[\]]+$|^\.|\.\.|\.$"), pairs)


def edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, from (host, html) and (host)."""
    links = pages.where(F.col("html").contains("//") & (F.col("host") != "")).select("host", F.explode(F.regexp_extract_all("html", F.lit(_HREF), 1)).alias("to"))
    links = links.select(F.col("host").alias("src"), F.translate("to", _UPPER, _LOWER).alias("dst")).where("src <> dst")
    up = hosts.select(F.explode(domains_of(F.col("host"))).alias("up")).select("up.*").distinct()
    return links.unionByName(up).unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).groupBy("src", "dst").agg(F.count("*").alias("n"))


#: The node that every host's teleport comes from; no host is empty.
_SOURCE = ""


def _moves(seeds: DataFrame, pairs: DataFrame, part: int) -> DataFrame:
    """(kind, src, part, dst, parts, rank, whole): what goes from src to dst each round, of the seeds' rank and of the
    uniform one; ``parts`` are those of dst as a source."""
    back = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    both = pairs.withColumn("kind", F.lit("trust")).unionByName(back.withColumn("kind", F.lit("distrust")))
    share = DAMPING * F.col("n") / F.col("total")
    links = both.join(both.groupBy("kind", "src").agg(F.sum("n").alias("total")), ["kind", "src"]).select("kind", "src", "dst", share.alias("rank"), share.alias("whole"))
    hosts = seeds.select("host").union(pairs.select("src")).union(pairs.select("dst")).distinct().join(seeds, "host", "left")
    mass = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.coalesce(c, F.lit(0.0)).alias("rank"))
    given = hosts.select("host", F.explode(F.array(mass("trust", F.col("allowed")), mass("distrust", F.col("blocked")))).alias("x"))
    given = given.select("x.kind", F.lit(_SOURCE).alias("src"), F.col("host").alias("dst"), "x.rank", F.lit(1.0).alias("whole"))
    stays = seeds.sparkSession.createDataFrame([(k, _SOURCE, _SOURCE, 1.0, 1.0) for k in ("trust", "distrust")], given.schema)
    every = common.stored(links.unionByName(given).unionByName(stays))
    parts = common.small(common.stored(every.groupBy("kind", "src").agg(F.ceil(F.count("*") / part).cast("int").alias("parts")).where("parts > 1")))
    own = every.join(parts, ["kind", "src"], "left").withColumn("part", F.pmod(F.xxhash64("dst"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    return common.stored(own.join(parts.withColumnRenamed("src", "dst"), ["kind", "dst"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))))


def propagated(seeds: DataFrame, pairs: DataFrame, tolerance: float = TOLERANCE, rounds: int = ROUNDS, part: int = PART) -> DataFrame:
    """(host, trust, distrust) from seeds (host, allowed, blocked: 0 to 1) and links (src, dst, n).

    rank = seed + DAMPING * sum of w * rank(src), for the seeds and for a seed of 1 at every host. Where all moves are few,
    they are broadcast and the rounds between two stored states run in one task; else each round is a shuffle.
    """
    moves = _moves(seeds, pairs, part)
    few = moves.limit(common.BROADCAST_ROWS + 1).count() <= common.BROADCAST_ROWS
    step = F.broadcast(moves) if few else moves
    step = step.withColumnsRenamed({"rank": "wr", "whole": "ww", "parts": "to_parts"})
    first = F.when(F.col("dst") == _SOURCE, 1.0).otherwise(F.col("rank"))
    held = common.Stored(moves.where(F.col("src") == _SOURCE).select("kind", F.col("dst").alias("host"), first.alias("rank"), F.lit(1.0).alias("whole"), "parts"))
    for _ in range(0, rounds, STRIDE):
        state = held.read().coalesce(1) if few else held.read()
        for _ in range(STRIDE):
            sent = state.select("kind", F.col("host").alias("src"), "rank", "whole", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
            came = sent.join(step, ["kind", "src", "part"]).groupBy("kind", F.col("dst").alias("host"))
            state = came.agg(F.sum(F.col("wr") * F.col("rank")).alias("rank"), F.sum(F.col("ww") * F.col("whole")).alias("whole"), F.max("to_parts").alias("parts"))
        following = common.Stored(state)
        before = held.read().select("kind", "host", F.col("rank").alias("was"), F.col("whole").alias("was_whole"))
        moved = F.greatest(F.abs(F.col("rank") - F.col("was")), F.abs(F.col("whole") - F.col("was_whole"))) / F.col("whole")
        change = following.read().join(F.broadcast(before) if few else before, ["kind", "host"]).agg(F.max(moved)).first()[0]
        held.drop()
        held = following
        if change is None or change < tolerance:
            of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("rank") / F.col("whole"))).alias(kind)
            return held.read().where(F.col("host") != _SOURCE).groupBy("host").agg(of("trust"), of("distrust"))
    raise RuntimeError(f"ranks still change by {change} after {rounds} rounds")


def judged(pages: DataFrame, rules=RULES, lift: float = LIFT) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of (page_id, url, html)."""
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    named = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    named = named.withColumn("rule", rule).withColumn("own", verdict)
    share = lambda kind: F.avg(F.when(F.col("own") == kind, 1.0).otherwise(0.0))
    seeds = common.stored(named.where("host <> ''").groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked")))
    pairs = common.stored(edges(named, seeds.select("host")))
    ranks = common.stored(propagated(seeds, pairs))
    mean = ranks.agg(F.avg("distrust")).first()[0] or 0.0
    table = common.small(ranks)
    found = named.drop("html").join(table, "host", "left").withColumn("trust", F.coalesce("trust", F.lit(0.0))).withColumn("distrust", F.coalesce("distrust", F.lit(0.0)))
    by_host = F.when((F.col("distrust") > lift * mean) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", F.coalesce("own", by_host).alias("verdict"), "trust", "distrust")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(common.table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
