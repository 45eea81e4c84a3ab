"""Conversation structure repair by a min-plus matrix scan.

A repaired conversation's roles are nothing, or an optional system turn and then one or more pairs of user and assistant turn. An automaton with
four states accepts these: start, after system, after user, after assistant. Each turn becomes a 4 x 4 matrix: what it costs, and
by which edits, to come from one state to another over it, by keeping, reroling or deleting it, after the insert closure (any number
of inserted turns before it). Elements are (cost, audit); a sum takes the lesser element, a product adds costs and concatenates audits. Two
audits of equal cost over the same turns are never prefixes of each other, as each added letter costs something, so the lesser audit stays the
lesser behind any common continuation: the product is associative and distributes, and any tree over the turns gives the same
cheapest edits, with ties broken by the least audit.

Equal rows of a conversation are counted first, so that none is hot; the first of equal (role, text) is found by an
aggregation; a range partition by (conversation, turn, role, text) numbers all rows, and runs of `RUN` rows are
reduced apart from each other. Runs of one conversation are joined, `FAN` at a time, level by level, so a conversation with a third of all
rows is spread over many tasks. Its audit comes back to the runs piece by piece, and every run repairs its own rows.
Memory of a task: the matrix of the runs that it joins, at the end 16 audits of the longest conversation.

Null roles and texts are one space; null conv_ids form a conversation; null turns come first. Rows of one turn (ties) are taken by role
and text. Empty and white texts are blank. Repeated rows are duplicates of the first. Very long texts are taken whole. A role other than
system, user and assistant can't be kept. An empty table gives no row; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taproot.llm import common

#: Rows that are reduced together, and results that are joined together.
RUN, FAN = 4096, 32
#: Characters of a text that the range partition looks at; rows that agree in them are sorted by whole texts within a task.
RANGE_CHARS = 128

KEEP, REROLE, DELETE, INSERT = (0, "K"), (2, "R"), (3, "D"), (2, "I")
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a role, from each state that the role may follow.
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ENDS = (START, ASSISTANT)
LEGAL_PAIRS = ("su", "ua", "au")

_WHITE = " \t\n\v\f\r"

Element = tuple[int, str] | None
Matrix = tuple[Element, ...]

ONE: Matrix = tuple((0, "") if i == j else None for i in range(4) for j in range(4))


def plus(a: Element, b: Element) -> Element:
    return b if a is None else a if b is None else min(a, b)


def times(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product; strings are only put together for the cheapest ways."""
    out: list[Element] = []
    for i in range(0, 16, 4):
        way = [(a[i + k], 4 * k) for k in range(4) if a[i + k]]
        for j in range(4):
            pairs = [(x, y) for x, k in way if (y := b[k + j])]
            least = min((x[0] + y[0] for x, y in pairs), default=0)
            out.append(min(((least, x[1] + y[1]) for x, y in pairs if x[0] + y[0] == least), default=None))
    return tuple(out)


def power(a: Matrix, n: int) -> Matrix:
    out = ONE
    while n:
        if n & 1:
            out = times(out, a)
        a, n = times(a, a) if n > 1 else a, n >> 1
    return out


def _edit(roles: str, edit: tuple[int, str], more: int = 0) -> list[tuple[int, int, Element]]:
    return [(a, b, (edit[0] + more, edit[1])) for r in roles for a, b in NEXT.get(r, {}).items()]


def _matrix(entries: list[tuple[int, int, Element]], base: Matrix = (None,) * 16) -> Matrix:
    out = list(base)
    for a, b, e in entries:
        out[4 * a + b] = plus(out[4 * a + b], e)
    return tuple(out)


#: No insertion, or up to three: more never lead to a new state.
INSERTS = power(_matrix(_edit("ua", INSERT), ONE), 3)


@lru_cache
def turn_matrix(kind: str) -> Matrix:
    """Of one turn after the insert closure. Kinds: x must be deleted; s, u, a and o (other) by role, in capitals if truncated."""
    entries = [(q, q, DELETE) for q in range(4)]
    if kind != "x":
        entries += _edit(kind.lower(), KEEP, kind.isupper()) + _edit("ua", REROLE, kind.isupper())
    return times(INSERTS, _matrix(entries))


@lru_cache(maxsize=50_000)
def _block(kinds: str) -> Matrix:
    return reduce(times, map(turn_matrix, kinds))


def product(kinds: str) -> Matrix:
    """Of turns in a row, as a balanced tree over blocks of four."""
    parts = [_block(kinds[i : i + 4]) for i in range(0, len(kinds), 4)]
    return tree(parts)


def tree(parts: list[Matrix]) -> Matrix:
    while len(parts) > 1:
        parts = [times(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else ONE


def cheapest(total: Matrix) -> tuple[int, str]:
    """Of the ways from the start to an accepting state, insertions at the end included."""
    row = times((*total[:4], *(None,) * 12), INSERTS)
    return reduce(plus, (row[q] for q in ENDS))


# --- rows ---------------------------------------------------------------------------------------------------------------


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows dropped, emptied, unended, repeated or given to the user, by a hash of their key."""
    fate = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn")).cast("binary")) % 20
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _text("role").alias("role"), _text("text").alias("text"), fate.alias("fate"))
    return rows.where("fate <> 0").select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("fate") == 3, 2).otherwise(1).cast("long").alias("copies"))


def faulted(rows: DataFrame) -> DataFrame:
    """Distinct (conv_id, turn, role, text, copies, fault, kind) of rows (…, copies); fault and kind are those of the first copy.

    The first of equal (role, text) has their least turn, and is joined to it by that turn too, so no key of the join is hot.
    """
    own = F.rtrim("text", F.lit(_WHITE))
    distinct = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    distinct = distinct.withColumn("own", F.right(own, F.lit(1))).withColumn("key", F.unhex(F.sha2("text", 256)))
    least = F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn"))
    firsts = distinct.where("own <> ''").groupBy("conv_id", "role", "key").agg(least.alias("least"))
    firsts = firsts.select(*(F.col(c).alias(f"first_{c}") for c in ("conv_id", "role", "key")), F.col("least.turn").alias("first_turn"), F.lit(True).alias("is_first"))
    same = [F.col(c).eqNullSafe(F.col(f"first_{c}")) for c in ("conv_id", "role", "key", "turn")]
    fault = F.when(F.col("own") == "", "blank").when(F.col("is_first").isNull(), "duplicate").when(~F.col("own").isin(".", "!", "?"), "truncated")
    met = distinct.join(firsts, reduce(Column.__and__, same), "left").withColumn("fault", fault)
    letter = F.when(F.left("role", F.lit(1)).isin("s", "u", "a"), F.left("role", F.lit(1))).otherwise("o")
    kind = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    return met.select("conv_id", "turn", "role", "text", "copies", "fault", kind.alias("kind"))


def ordered(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows of `faulted` with their rank over all conversations and the run that it lies in, stored. ``parts``: tasks to sort them in."""
    keys = ["conv_id", "turn", "role"]
    ranked = common.ranked(rows, [*map(F.col, keys), F.col("text")], ranges=[*map(F.col, keys), F.left("text", F.lit(RANGE_CHARS))], parts=parts)
    return ranked.withColumn("run", F.floor(F.col("rank") / RUN))


SUMMARY = (
    "conv_id long, run long, n long, first_initial string, last_initial string, first_turn long, last_turn long, turns long, "
    "blank long, duplicate long, truncated long, illegal long, costs array<long>, audits array<string>"
)
_COUNTS = ("n", "turns", "blank", "duplicate", "truncated", "illegal")


def _arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096, chars: int = 8_000_000, column: int = -1) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``most`` rows, and about ``chars`` characters in a column."""

    def batch(part: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)

    part, size = [], 0
    for row in rows:
        part.append(row)
        size += len(row[column] or "")
        if len(part) >= most or size > chars:
            yield batch(part)
            part, size = [], 0
    if part:
        yield batch(part)


def _mapped(df: DataFrame, solve, ddl: str, column: int = -1) -> DataFrame:
    """``solve`` turns an iterator of a partition's rows into rows of ``ddl``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(ddl)
    arrow = to_arrow_schema(schema)
    return df.mapInArrow(lambda batches: _batches(solve(_arrow(batches)), arrow, column=column), schema)


def _flat(m: Matrix) -> tuple[list, list]:
    return [e and e[0] for e in m], [e and e[1] for e in m]


def _summaries(rows: Iterator[tuple]) -> Iterator[tuple]:
    """A summary of each run's part of a conversation."""
    key, s, kinds, done = None, {}, [], []

    def closed() -> tuple:
        total = tree([*done, product("".join(kinds))])
        return (*key, *(s[c] for c in SUMMARY_COLUMNS[2:12]), *_flat(total))

    for conv, run, turn, role, copies, fault, kind in rows:
        if (conv, run) != key:
            if key:
                yield closed()
            key, kinds, done = (conv, run), [], []
            s = dict.fromkeys(SUMMARY_COLUMNS[2:12]) | dict.fromkeys(_COUNTS, 0)
            s["first_initial"], s["first_turn"] = role[:1], turn
        initial = role[:1]
        s["illegal"] += (s["last_initial"] is not None and s["last_initial"] + initial not in LEGAL_PAIRS) + copies - 1
        s["turns"] += turn is not None and turn != s["last_turn"]
        if s["first_turn"] is None:
            s["first_turn"] = turn
        s["last_turn"], s["last_initial"] = turn, initial
        s["n"] += copies
        if fault:
            s[fault] += 1
        if copies > 1:
            s["blank" if fault == "blank" else "duplicate"] += copies - 1
        kinds.append(kind)
        if copies > RUN:
            done += [product("".join(kinds)), power(turn_matrix("x"), copies - 1)]
            kinds = []
        else:
            kinds.append("x" * (copies - 1))
    if key:
        yield closed()


SUMMARY_COLUMNS = [f.split()[0] for f in SUMMARY.split(", ")]


def _joined(parts: list[dict]) -> dict:
    """The summary of runs in a row."""
    out = parts[0] | {c: sum(p[c] for p in parts) for c in _COUNTS}
    for p in parts[1:]:
        out["illegal"] += out["last_initial"] + p["first_initial"] not in LEGAL_PAIRS
        if p["first_turn"] is not None:  # nulls come first, so what follows has turns too
            out["turns"] -= out["last_turn"] == p["first_turn"]
            out["first_turn"] = p["first_turn"] if out["first_turn"] is None else out["first_turn"]
        out["last_turn"], out["last_initial"] = p["last_turn"], p["last_initial"]
    total = tree([tuple(None if c is None else (c, a) for c, a in zip(p["costs"], p["audits"], strict=True)) for p in parts])
    out["costs"], out["audits"] = _flat(total)
    return out


def _levels(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows of (parent, summary) sorted by conversation, parent and run: one summary each."""
    key, parts = None, []
    for parent, *values in rows:
        p = dict(zip(SUMMARY_COLUMNS, values, strict=True))
        if (p["conv_id"], parent) != key:
            if parts:
                yield tuple((_joined(parts) | {"run": key[1]}).values())
            key, parts = (p["conv_id"], parent), []
        parts.append(p)
    if parts:
        yield tuple((_joined(parts) | {"run": key[1]}).values())


def run_summaries(rows: DataFrame) -> DataFrame:
    """A summary of each run of a conversation, stored."""
    narrow = rows.select("conv_id", "run", "turn", "role", "copies", "fault", "kind", "rank")
    dealt = narrow.repartition(F.col("run")).sortWithinPartitions("run", "rank").drop("rank")
    return common.stored(_mapped(dealt, _summaries, SUMMARY))


def totals(summaries: DataFrame) -> DataFrame:
    """One summary per conversation: neighbouring runs are joined level by level until no conversation has two."""
    again = lambda s: s.groupBy("conv_id").agg(F.count("*").alias("runs")).where("runs > 1").select("conv_id")
    done, rest = None, summaries
    while True:
        several = common.stored(again(rest))
        if not several.limit(1).count():
            return rest if done is None else done.unionByName(rest)
        on = F.col("conv_id").eqNullSafe(F.col("several"))
        several = several.select(F.col("conv_id").alias("several"))
        alone = rest.join(several, on, "left_anti")
        done = alone if done is None else done.unionByName(alone)
        parent = rest.join(several, on, "left_semi").select(F.floor(F.col("run") / FAN).alias("parent"), *SUMMARY_COLUMNS)
        dealt = parent.repartition("conv_id", "parent").sortWithinPartitions("conv_id", "parent", "run")
        rest = common.stored(_mapped(dealt, _levels, SUMMARY))


def judged(total: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of whole conversations' summaries."""

    def solve(rows: Iterator[tuple]) -> Iterator[tuple]:
        for row in rows:
            s = dict(zip(SUMMARY_COLUMNS, row, strict=True))
            matrix = tuple(None if c is None else (c, a) for c, a in zip(s["costs"], s["audits"], strict=True))
            gaps = 0 if s["last_turn"] is None else s["last_turn"] - s["first_turn"] + 1 - s["turns"]
            yield (s["conv_id"], gaps, *(s[c] for c in ("blank", "duplicate", "truncated", "illegal")), *cheapest(matrix))

    return _mapped(total, solve, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def _pieces(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows (conv_id, run, n, audit) sorted by conversation and run, the audit first: what of it belongs to each run."""
    conv, ops, audit, seen, outs, at, n_turns, system = None, None, b"", 0, None, 0, 0, False
    for conv, run, n, text in rows:
        if text is not None:
            audit = np.frombuffer(text.encode(), np.uint8)
            ops, outs = np.flatnonzero(audit != ord("I")), np.concatenate([[0], np.cumsum(audit != ord("D"))])
            at, seen, n_turns, system = 0, 0, len(ops), bool(outs[-1] % 2)
            continue
        seen += n
        end = len(audit) if seen == n_turns else int(ops[seen - 1]) + 1
        yield conv, run, at, int(outs[at]), system, audit[at:end].tobytes().decode()
        at = end


def _repaired(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows sorted by (run, conversation, rank), each run's piece of an audit first: its turns after repair."""
    conv, at, out, system, audit, place = None, 0, 0, False, "", 0

    def inserted() -> Iterator[tuple]:
        nonlocal place, out
        while audit[place : place + 1] == "I":
            yield conv, at + place, "I", None, *spoken("I", None, "")
            place, out = place + 1, out + 1

    def spoken(edit: str, role: str | None, text: str | None) -> tuple[str | None, str | None]:
        own = ("user", "assistant")[(out - system) % 2]
        return (None, None) if edit == "D" else (role if edit == "K" else own, text)

    for c, turn, role, text, copies, first_at, first_out, is_system, piece in rows:
        if piece is not None:
            yield from inserted()
            conv, at, out, system, audit, place = c, first_at, first_out, is_system, piece, 0
            continue
        for _ in range(copies):
            yield from inserted()
            edit = audit[place]
            yield conv, at + place, edit, turn, *spoken(edit, role, text)
            place, out = place + 1, out + (edit != "D")
    yield from inserted()


def repaired(rows: DataFrame, summaries: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(conv_id, position, edit, turn, role, text): every edit, in order; deleted turns have no role, inserted ones no turn."""
    audits = verdicts.select("conv_id", F.lit(-1).cast("long").alias("run"), F.lit(0).cast("long").alias("n"), "audit")
    runs = summaries.select("conv_id", "run", "n", F.lit(None).cast("string").alias("audit")).unionByName(audits)
    dealt = runs.repartition("conv_id").sortWithinPartitions("conv_id", "run")
    pieces = _mapped(dealt, _pieces, "conv_id long, run long, at long, out long, system boolean, piece string")
    none = lambda kind: F.lit(None).cast(kind)
    first = pieces.select("conv_id", "run", F.lit(-1).cast("long").alias("rank"), none("long").alias("turn"), none("string").alias("role"), none("string").alias("text"), none("long").alias("copies"), "at", "out", "system", "piece")
    text = F.when(F.col("kind") != "x", F.col("text"))
    own = rows.select("conv_id", "run", "rank", "turn", "role", text.alias("text"), "copies", none("long").alias("at"), none("long").alias("out"), none("boolean").alias("system"), none("string").alias("piece"))
    dealt = first.unionByName(own).repartition("run", "conv_id").sortWithinPartitions("run", "conv_id", "rank")
    return _mapped(dealt.drop("run", "rank"), _repaired, "conv_id long, position long, edit string, turn long, role string, text string")


def _digests(rows: Iterator[tuple]) -> Iterator[tuple]:
    conv, sha, began = None, None, False
    for c, role, text in rows:
        if not began or c != conv:
            if began:
                yield conv, sha.hexdigest()
            conv, sha, began = c, hashlib.sha256(), True
        else:
            sha.update(b"\n")
        sha.update(f"{role}:{text}".encode())
    if began:
        yield conv, sha.hexdigest()


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of `repaired`. A hash goes over a whole conversation in order, so one task reads each, row by row."""
    said = turns.where("role IS NOT NULL").select("conv_id", "position", "role", "text")
    dealt = said.repartition("conv_id").sortWithinPartitions("conv_id", "position").drop("position")
    return _mapped(dealt, _digests, "conv_id long, repaired_sha256 string")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = common.table(spark, sf_dir, "conversations")
    rows = ordered(faulted(damaged(given)), common.partitions(given))
    summaries = run_summaries(rows)
    verdicts = common.stored(judged(totals(summaries)))
    same = lambda c: F.col("id").eqNullSafe(F.col(c))
    ids = given.select(F.col("conv_id").cast("long").alias("id")).distinct()
    found = ids.join(verdicts, same("conv_id"), "left").drop("conv_id").join(digests(repaired(rows, summaries, verdicts)), same("conv_id"), "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256")
    return found.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), empty)


# --- the same question in SQL ---------------------------------------------------------------------------------------------


def _oracle() -> str:
    """One turn after the other by a recursive query; a state is (cost c, audit a, text t) and 10^9 stands for unreached."""
    white, pattern = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    add = lambda v, cost, letter, text: f"struct_pack(c := {v}.c + {cost}, a := {v}.a || '{letter}', t := {v}.t || {text})"
    said = lambda role, text="''": f"chr(10) || {role} || ':' || {text}"
    insert = lambda v, role: add(v, 2, "I", said(f"'{role}'"))
    least = lambda *ways: f"list_min([{', '.join(ways)}])"
    delete = lambda v: add(v, 3, "D", "''")
    keep = lambda v, initial: add(v, f"(CASE WHEN initial = '{initial}' AND kind <> 'x' THEN late ELSE 1000000000 END)", "K", said("role", "text"))
    rerole = lambda v, role: add(v, "(CASE WHEN kind <> 'x' THEN 2 + late ELSE 1000000000 END)", "R", said(f"'{role}'", "text"))
    to_user = [f(v) for v in ("v0", "v1", "v3") for f in (lambda v: keep(v, "u"), lambda v: rerole(v, "user"))]
    closed = f"""v0, v1, {least("v2", *(insert(v, "user") for v in ("v0", "v1", "v3")))} AS v2, v3"""
    closed_again = f"v0, v1, v2, {least('v3', insert('v2', 'assistant'))} AS v3"
    far = "struct_pack(c := 1000000000::BIGINT, a := '', t := '')"
    return rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
fated AS (
  SELECT *, xor(4294967295, list_reduce(flatten([[ascii(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0] FOR ch IN string_split(key, '')]),
    lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1)), 4294967295::BIGINT)) % 20 AS fate FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM fated WHERE fate <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    role[1:1] AS initial, regexp_replace(text, '{white}+$', '') AS own FROM damaged),
rows AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '{pattern}') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN own[-1:] NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM placed),
kinds AS (
  SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' ELSE initial END AS kind, (fault = 'truncated')::BIGINT AS late FROM rows),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM rows GROUP BY conv_id),
scan AS (
  SELECT conv_id, 0::BIGINT AS i, struct_pack(c := 0::BIGINT, a := '', t := '') AS v0, {far} AS v1, {far} AS v2, {far} AS v3 FROM counts
  UNION ALL
  SELECT conv_id, i, {delete("v0")}, {least(delete("v1"), keep("v0", "s"))}, {least(delete("v2"), *to_user)},
    {least(delete("v3"), keep("v2", "a"), rerole("v2", "assistant"))}
  FROM (SELECT conv_id, i, role, text, initial, kind, late, {closed_again}
    FROM (SELECT k.conv_id, k.i, k.role, k.text, k.initial, k.kind, k.late, {closed}
      FROM scan s JOIN kinds k ON k.conv_id IS NOT DISTINCT FROM s.conv_id AND k.i = s.i + 1))),
ended AS (
  SELECT conv_id, {least("v0", "v3")} AS e
  FROM (SELECT conv_id, {closed_again} FROM (SELECT s.conv_id, {closed} FROM scan s JOIN counts c ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND c.n = s.i)))
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(e.c, 0) AS cost, coalesce(e.a, '') AS audit, sha256(coalesce(e.t[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended x ON x.conv_id IS NOT DISTINCT FROM o.conv_id
"""


ORACLE_SQL = _oracle()
