"""Conditional constant propagation over tables.

A function's blocks are joined by flow (fn, src, dst, side): ``side`` is 'true' or 'false' for the ways of a condition and null for a
way that is always taken; flow from null leads to the entry. Its steps are (fn, block, target, op, left_var, left, right_var, right,
loop): ``target`` is the variable that a step sets, or null for the block's condition; an operand is a variable or a literal. Values are
strings: an integer, 'true', 'false' or 'nil'. ``op`` is null for the left operand itself, one of `OPERATORS`, or 'call' for what isn't known.

A variable is unknown until an executable step sets it, a constant while all of them agree, and varying (`VARYING`) from then on.
A way is executable if its block is entered and its condition doesn't rule it out. Values only sink and ways only become executable, so
both grow together to one fixpoint, whatever the order. A condition whose variable no executable step sets (a parameter, say)
says nothing: when all else has settled, both ways of all such conditions are taken at once, and so on until nothing is new.

Functions are solved one by one in the tasks of one shuffle (`dataflow.solved`), larger ones by joins. Sums and products beyond
64 bits and division by zero are varying; division cuts towards zero.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taproot.operators.dataflow import solved
from taproot.storage import stored

VARYING = "?"
ARITHMETIC = ("+", "-", "*", "/", "%")
COMPARISONS = ("==", "!=", "<", "<=", ">", ">=")
LOGIC = ("&&", "||")
OPERATORS = (*ARITHMETIC, *COMPARISONS, *LOGIC, "!", "negate")
OPERANDS = ("op", "left_var", "left", "right_var", "right")
_BOOLEAN = ("false", "true")
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _integer(value: str) -> int | None:
    digits = value.removeprefix("-")
    return int(value) if digits.isascii() and digits.isdigit() and _LEAST <= int(value) <= _MOST else None


def folded(op: str | None, left: str | None, right: str | None) -> str | None:
    """The value of an operation; null (unknown) if an operand is, else varying if one is or the operation doesn't fit."""
    if op == "call":
        return VARYING
    unary = op in (None, "!", "negate")
    if left is None or not unary and right is None:
        return None
    if op is None:
        return left
    if VARYING in (left, right if not unary else left):
        return VARYING
    if unary:
        n = _integer(left)
        if op == "!":
            return _BOOLEAN[left == "false"] if left in _BOOLEAN else VARYING
        return str(-n) if n is not None and -n <= _MOST else VARYING
    a, b = _integer(left), _integer(right)
    if a is None or b is None:
        if left in _BOOLEAN and right in _BOOLEAN:
            x, y = left == "true", right == "true"
            known = {"&&": x and y, "||": x or y, "==": x == y, "!=": x != y}
            return _BOOLEAN[known[op]] if op in known else VARYING
        return VARYING
    if op in COMPARISONS:
        return _BOOLEAN[{"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]]
    if op in ("/", "%"):
        if b == 0:
            return VARYING
        whole = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
        n = whole if op == "/" else a - b * whole
    elif op in ARITHMETIC:
        n = a + b if op == "+" else a - b if op == "-" else a * b
    else:
        return VARYING
    return str(n) if _LEAST <= n <= _MOST else VARYING


def folded_column(op: Column, left: Column, right: Column) -> Column:
    """`folded` as a column."""
    # An integer has no sign but a minus, and no spaces.
    a, b = (F.when(c.rlike("^-?[0-9]+$"), c.try_cast("long")) for c in (left, right))
    unary = op.isNull() | op.isin("!", "negate")
    truth = lambda test: F.when(test, "true").otherwise("false")
    both = lambda f: f(a, b)
    numbers = [
        ("+", both(F.try_add)), ("-", both(F.try_subtract)), ("*", both(F.try_multiply)),
        ("/", F.when((a == _LEAST) & (b == -1), None).otherwise(F.call_function("div", a, F.nullif(b, F.lit(0))))), ("%", both(F.try_mod)),
    ]
    tests = [("==", a == b), ("!=", a != b), ("<", a < b), ("<=", a <= b), (">", a > b), (">=", a >= b)]
    x, y = left == "true", right == "true"
    logic = [("&&", x & y), ("||", x | y), ("==", x == y), ("!=", x != y)]
    case = lambda pairs, cast: F.coalesce(*(F.when(op == o, cast(c)) for o, c in pairs), F.lit(VARYING))
    of_numbers = F.when(op.isin(*ARITHMETIC), case(numbers, lambda c: c.cast("string"))).otherwise(case(tests, truth))
    of_booleans = case(logic, truth)
    negated = F.when(F.coalesce(a != _LEAST, F.lit(False)), F.negate(a).cast("string")).otherwise(VARYING)
    inverted = F.when(left.isin(*_BOOLEAN), truth(left == "false")).otherwise(VARYING)
    binary = F.when(a.isNotNull() & b.isNotNull(), of_numbers).when(left.isin(*_BOOLEAN) & right.isin(*_BOOLEAN), of_booleans).otherwise(VARYING)
    known = F.when(op == "!", inverted).when(op == "negate", negated).otherwise(binary)
    return (
        F.when(F.coalesce(op == "call", F.lit(False)), VARYING)
        .when(left.isNull() | ~unary & right.isNull(), None)
        .when(op.isNull(), left)
        .when((left == VARYING) | ~unary & (right == VARYING), VARYING)
        .otherwise(known)
    )


# Rows of a solution: what, block or variable, target block or value.
EDGE, VALUE = "edge", "value"


def _solve(rows: list[tuple]) -> Iterator[tuple]:
    """(fact, block, dst, name, value) of one function: flow rows have a dst, the others are steps."""
    flow, assigns, conditions, readers = defaultdict(list), defaultdict(list), defaultdict(list), defaultdict(set)
    for is_flow, block, dst, side, target, *operands in rows:
        if is_flow:
            flow[block].append((dst, side))
            continue
        (conditions if target is None else assigns)[block].append((target, operands))
        for name in (operands[1], operands[3]):
            if name is not None:
                readers[name].add(block)
    values: dict[str, str] = {}
    taken: set[tuple] = set()
    entered: set = set()

    def value(operands: list) -> str | None:
        op, left_var, left, right_var, right = operands
        return folded(op, values.get(left_var) if left_var is not None else left, values.get(right_var) if right_var is not None else right)

    def open_ways(block: object, unknown: str | None) -> list:
        """Blocks that are entered now; ``unknown`` stands for a condition's unknown value."""
        known = [k if (k := value(operands)) is not None else unknown for _, operands in conditions[block]]
        again = []
        for dst, side in flow[block]:
            if (block, dst) not in taken and (side is None or any(k is not None and (k not in _BOOLEAN or k == side) for k in known)):
                taken.add((block, dst))
                if dst not in entered:
                    entered.add(dst)
                    again.append(dst)
        return again

    def visit(block: object) -> list:
        """What to look at again."""
        again = []
        for target, operands in assigns[block]:
            new, old = value(operands), values.get(target)
            new = old if new is None or old == VARYING else new if old is None or new == old else VARYING
            if new != old:
                values[target] = new
                again += [b for b in readers[target] if b in entered]
        return again + open_ways(block, None)

    entered.update(dst for dst, _ in flow[None])
    todo = list(entered)
    while todo:
        while todo:
            todo += visit(todo.pop())
        settled = [b for b in entered if any(value(operands) is None for _, operands in conditions[b])]
        todo = [b for block in settled for b in open_ways(block, VARYING)]
    for src, dst in taken:
        yield EDGE, src, dst, None, None
    for name, v in values.items():
        yield VALUE, None, None, name, v


def _by_joins(rows: DataFrame) -> DataFrame:
    """The same for functions of any size: a round sets all values and opens all ways that the last one allows."""
    flow = stored(rows.where("is_flow").select("fn", F.col("block").alias("src"), "dst", "side"))
    steps = stored(rows.where("NOT is_flow").select("fn", "block", "target", *OPERANDS))
    entry = flow.where("src IS NULL").select("fn", F.col("dst").alias("block")).distinct()
    inner = stored(flow.where("src IS NOT NULL"))
    fn, block, name = steps.schema["fn"].dataType, steps.schema["block"].dataType, steps.schema["target"].dataType
    empty = F.lit(False)
    edges = inner.where(empty).select("fn", "src", "dst")
    values = steps.where(empty).select("fn", F.col("target").alias("name"), F.lit("").alias("value"))
    open_sides, was = False, None
    while True:
        entered = entry.unionByName(edges.select("fn", F.col("dst").alias("block"))).distinct()
        live = steps.join(entered, ["fn", "block"], "left_semi")
        for side in ("left", "right"):
            own = values.select("fn", F.col("name").alias(f"{side}_var"), F.col("value").alias(f"{side}_value"))
            live = live.join(own, ["fn", f"{side}_var"], "left")
        operand = lambda side: F.when(F.col(f"{side}_var").isNull(), F.col(side)).otherwise(F.col(f"{side}_value"))
        live = stored(live.select("fn", "block", "target", folded_column(F.col("op"), operand("left"), operand("right")).alias("value")))
        given = live.where("target IS NOT NULL AND value IS NOT NULL").select("fn", F.col("target").alias("name"), "value").unionByName(values)
        one = (F.min("value") == F.max("value")) & (F.min("value") != VARYING)
        values = stored(given.groupBy("fn", "name").agg(F.when(one, F.min("value")).otherwise(VARYING).alias("value")))
        said = live.where("target IS NULL").select("fn", F.col("block").alias("src"), F.coalesce("value", F.lit(VARYING) if open_sides else F.lit(None).cast("string")).alias("known"))
        sides = inner.where("side IS NOT NULL").join(said.where("known IS NOT NULL"), ["fn", "src"]).where("known NOT IN ('true', 'false') OR known = side")
        plain = inner.where("side IS NULL").join(entered.withColumnRenamed("block", "src"), ["fn", "src"], "left_semi")
        edges = stored(plain.select("fn", "src", "dst").unionByName(sides.select("fn", "src", "dst")).unionByName(edges).distinct())
        now = (edges.count(), values.count(), values.where(F.col("value") == VARYING).count())
        if now == was and open_sides:
            break
        open_sides, was = now == was, now
    null = lambda kind: F.lit(None).cast(kind)
    found = edges.select("fn", F.lit(EDGE).alias("fact"), F.col("src").alias("block"), "dst", null(name).alias("name"), null("string").alias("value"))
    return found.unionByName(values.select("fn", F.lit(VALUE).alias("fact"), null(block).alias("block"), null(block).alias("dst"), "name", "value"))


def propagated(flow: DataFrame, steps: DataFrame) -> DataFrame:
    """(fn, fact, block, dst, name, value): executable ways (fact 'edge') and the values of variables (fact 'value'), stored."""
    own = flow.select("fn", F.lit(True).alias("is_flow"), F.col("src").alias("block"), "dst", "side").where("dst IS NOT NULL")
    rows = own.unionByName(steps.select("fn", F.lit(False).alias("is_flow"), "block", "target", *OPERANDS), allowMissingColumns=True)
    rows = rows.select("fn", "is_flow", "block", "dst", "side", "target", *OPERANDS)
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    names = [("fn", kinds["fn"]), ("fact", T.StringType()), ("block", kinds["block"]), ("dst", kinds["block"]), ("name", kinds["target"]), ("value", T.StringType())]
    return solved(rows, T.StructType([T.StructField(*n) for n in names]), _solve, _by_joins)


def executable_edges(found: DataFrame) -> DataFrame:
    return found.where(F.col("fact") == EDGE).select("fn", F.col("block").alias("src"), "dst")


def values(found: DataFrame) -> DataFrame:
    """(fn, name, value); varying variables included, those that no executable step sets not."""
    return found.where(F.col("fact") == VALUE).select("fn", "name", "value")


def unreachable_blocks(flow: DataFrame, found: DataFrame) -> DataFrame:
    """(fn, block) of blocks that no executable way enters."""
    entered = executable_edges(found).select("fn", F.col("dst").alias("block")).unionByName(flow.where("src IS NULL").select("fn", F.col("dst").alias("block")))
    named = flow.select("fn", F.explode(F.array("src", "dst")).alias("block")).where("block IS NOT NULL").distinct()
    return named.join(entered.distinct(), ["fn", "block"], "left_anti")


def dead_branches(flow: DataFrame, steps: DataFrame, found: DataFrame) -> DataFrame:
    """(fn, block, side, value): sides of a condition that never run, where the block does and the condition is one constant.

    A loop whose condition is always true goes on on purpose: its way out is no dead branch.
    """
    known = values(found)
    asked = steps.where("target IS NULL").select("fn", "block", "loop", *OPERANDS)
    for side in ("left", "right"):
        own = known.select("fn", F.col("name").alias(f"{side}_var"), F.col("value").alias(f"{side}_value"))
        asked = asked.join(own, ["fn", f"{side}_var"], "left")
    operand = lambda side: F.when(F.col(f"{side}_var").isNull(), F.col(side)).otherwise(F.col(f"{side}_value"))
    constant = asked.select("fn", "block", "loop", folded_column(F.col("op"), operand("left"), operand("right")).alias("value")).where(F.col("value").isin(*_BOOLEAN))
    constant = constant.where(~(F.coalesce("loop", F.lit(False)) & (F.col("value") == "true")))
    ways = flow.where("side IS NOT NULL").select("fn", F.col("src").alias("block"), "dst", "side")
    unused = ways.join(executable_edges(found).withColumnRenamed("src", "block"), ["fn", "block", "dst"], "left_anti")
    dead = unused.join(constant, ["fn", "block"]).where("side <> value").select("fn", "block", "side", "value")
    entered = unreachable_blocks(flow, found)
    return dead.join(entered, ["fn", "block"], "left_anti").distinct()
