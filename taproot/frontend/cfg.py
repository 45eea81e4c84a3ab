"""Control flow of function bodies.

A body's statements become blocks: ``if``/``guard``/``while``/``repeat``/``for``/``switch`` branch, ``return``/``throw``/``break``/``continue``
leave. `rows` gives them as tables, from which `taproot.plans.control_flow` finds dead branches and stores.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from taproot.frontend.lexer import Lexer, Token

#: Statements of a body, nested ones included, after which it isn't analysed.
MOST_STATEMENTS = 5000
_COMPOUND = ("+=", "-=", "*=", "/=", "%=")


@dataclass
class Statement:
    line: int
    defs: list[str] = field(default_factory=list)
    uses: list[str] = field(default_factory=list)
    value: str | None = None
    closure_writes: list[str] = field(default_factory=list)
    #: What the statement declares; only such variables are judged.
    declared: list[str] = field(default_factory=list)


@dataclass
class Block:
    id: int
    kind: str = "plain"
    statements: list[Statement] = field(default_factory=list)
    successors: list[int] = field(default_factory=list)
    condition: str | None = None
    line: int = 0
    has_else: bool = False


class Builder:
    """Blocks of one body, given as the tokens between its braces."""

    def __init__(self, tokens: list[Token]) -> None:
        self.t, self.at, self.blocks, self.count = tokens, 0, [], 0
        self.loops: list[tuple[int, int]] = []
        self.breaks: list[int] = []
        self.now = self.new()
        self.exit = self.new("exit")
        self.run(len(tokens))
        self.link(self.now, self.exit)

    def new(self, kind: str = "plain") -> Block:
        self.blocks.append(Block(len(self.blocks), kind))
        return self.blocks[-1]

    def link(self, a: Block | None, b: Block) -> None:
        if a is not None and b.id not in a.successors:
            a.successors.append(b.id)

    def closing(self, at: int) -> int:
        pairs, depth = {"(": ")", "[": "]", "{": "}"}, 0
        for i in range(at, len(self.t)):
            x = self.t[i].text if self.t[i].kind == "punctuation" else ""
            depth += (x in pairs) - (x != "" and x in ")]}")
            if depth == 0:
                return i
        return len(self.t) - 1

    def here(self) -> Block:
        if self.now is None:  # what follows a return can't be reached
            self.now = self.new()
        return self.now

    def run(self, end: int) -> None:
        while self.at < end:
            self.statement(end)

    def body(self) -> None:
        """A braced body; the place is after it."""
        end = self.closing(self.at)
        self.at += 1
        self.run(end)
        self.at = end + 1

    def header(self, end: int) -> tuple[str, list[Token]]:
        first, depth = self.at, 0
        while self.at < end and not (self.t[self.at].text == "{" and depth == 0):
            x = self.t[self.at]
            if x.kind == "punctuation":
                depth += (x.text in "([") - (x.text in ")]")
            self.at += 1
        own = self.t[first : self.at]
        return " ".join(x.text for x in own), own

    def branch(self, condition: str, tokens: list[Token], line: int, kind: str) -> Block:
        block = self.here()
        if tokens:
            self.simple(tokens)
        block.condition, block.line, block.kind = condition, line, kind
        return block

    def statement(self, end: int) -> None:
        t = self.t[self.at]
        self.count += 1
        if t.text == "if":
            self.if_(end)
        elif t.text == "guard":
            self.at += 1
            first = self.at
            while self.at < end and self.t[self.at].text != "else":
                self.at += 1
            own = self.t[first : self.at]
            head = self.branch(" ".join(x.text for x in own), own, t.line, "guard")
            self.at += 1
            on, other = self.new(), self.new()
            head.successors = [on.id, other.id]
            self.now = other
            self.body()
            self.now = on
        elif t.text in ("while", "for"):
            self.at += 1
            loop = self.new("loop")
            self.link(self.here(), loop)
            self.now = loop
            condition, own = self.header(end)
            if t.text == "for":
                self.simple(own)
                condition = ""
            elif own:
                self.simple(own)
            loop.condition, loop.line, loop.kind = condition or None, t.line, "while" if t.text == "while" else "for"
            inside, after = self.new(), self.new()
            loop.successors = [inside.id, after.id]
            self.loop_body(inside, loop, after)
        elif t.text == "repeat":
            self.at += 1
            inside, test, after = self.new(), self.new("repeat"), self.new()
            self.link(self.here(), inside)
            self.loop_body(inside, test, None, after)
            self.now = test
            if self.at < end and self.t[self.at].text == "while":
                line = self.t[self.at].line
                self.at += 1
                own = self.line(end)
                self.simple(own)
                test.condition, test.line = " ".join(x.text for x in own), line
            test.successors = [inside.id, after.id]
            self.now = after
        elif t.text == "switch":
            self.switch(end)
        elif t.text == "do":
            self.at += 1
            start = self.here()
            self.body()
            after = self.new()
            self.link(self.now, after)
            while self.at < end and self.t[self.at].text == "catch":
                self.at += 1
                caught = self.new()
                self.link(start, caught)
                self.now = caught
                _, own = self.header(end)
                self.simple(own)
                self.body()
                self.link(self.now, after)
            self.now = after
        elif t.text in ("return", "throw"):
            self.at += 1
            self.simple(self.line(end))
            self.link(self.here(), self.blocks[1])
            self.now = None
        elif t.text in ("break", "continue"):
            self.at += 1
            if self.at < end and self.t[self.at].kind == "name" and self.t[self.at].line == t.line:
                self.at += 1
            target = (self.loops[-1][0] if self.loops else None) if t.text == "continue" else (self.breaks[-1] if self.breaks else None)
            if target is not None:
                self.link(self.here(), self.blocks[target])
                self.now = None
        elif t.text == "{":
            self.body()
        elif t.text in (";", "}"):
            self.at += 1
        else:
            own = self.line(end)
            if not own:
                self.at += 1
            self.simple(own)

    def loop_body(self, inside: Block, again: Block, after: Block | None, out: Block | None = None) -> None:
        self.loops.append((again.id, (after or out).id))
        self.breaks.append((after or out).id)
        self.now = inside
        self.body()
        self.link(self.now, again)
        self.loops.pop()
        self.breaks.pop()
        if after:
            self.now = after

    def if_(self, end: int) -> None:
        line = self.t[self.at].line
        self.at += 1
        condition, own = self.header(end)
        head = self.branch(condition, own, line, "if")
        on, after = self.new(), self.new()
        self.now = on
        self.body()
        self.link(self.now, after)
        if self.at < end and self.t[self.at].text == "else":
            self.at += 1
            other = self.new()
            head.has_else = True
            head.successors = [on.id, other.id]
            self.now = other
            self.if_(end) if self.at < end and self.t[self.at].text == "if" else self.body()
            self.link(self.now, after)
        else:
            head.successors = [on.id, after.id]
        self.now = after

    def switch(self, end: int) -> None:
        self.at += 1
        _, own = self.header(end)
        self.simple(own)
        head, after, stop = self.here(), self.new(), self.closing(self.at)
        self.at += 1
        self.breaks.append(after.id)
        through: Block | None = None
        while self.at < stop:
            case = self.new()
            self.link(head, case)
            self.link(through, case)
            through, self.now = None, case
            depth = 0
            while self.at < stop and not (self.t[self.at].text == ":" and depth == 0):
                depth += (self.t[self.at].text in ("(", "[")) - (self.t[self.at].text in (")", "]"))
                self.at += 1
            self.at += 1
            while self.at < stop and self.t[self.at].text not in ("case", "default", "fallthrough"):
                self.statement(stop)
            if self.at < stop and self.t[self.at].text == "fallthrough":
                self.at += 1
                through = self.now
            else:
                self.link(self.now, after)
        self.breaks.pop()
        self.at, self.now = stop + 1, after

    def line(self, end: int) -> list[Token]:
        """Tokens of one simple statement: to the line's end, outside brackets, unless an operator goes on."""
        first, depth = self.at, 0
        while self.at < end:
            x = self.t[self.at]
            if depth == 0 and self.at > first:
                before = self.t[self.at - 1]
                if x.text in (";", "}") or x.line != before.line and x.kind != "operator" and x.text not in (".", "?", ":") and before.kind != "operator" and before.text not in (",", "=", ".", "("):
                    break
            if x.kind == "punctuation":
                depth += (x.text in "([{") - (x.text in ")]}")
            if depth < 0:
                break
            self.at += 1
        return self.t[first : self.at]

    def simple(self, tokens: list[Token]) -> None:
        if not tokens:
            return
        s = Statement(tokens[0].line)
        inside = 0
        for i, x in enumerate(tokens):
            after = tokens[i + 1].text if i + 1 < len(tokens) else ""
            before = tokens[i - 1].text if i else ""
            inside += (x.text == "{") - (x.text == "}")
            if x.kind == "string":
                s.uses += [y.text for y in x.inner if y.kind == "name"]
            if x.kind != "name" or x.text == "_" or before == ".":
                continue
            if before == "&" and not tokens[i - 1].space_before or before == "&" and i > 1 and tokens[i - 2].text in ("(", ",", ":"):
                s.closure_writes.append(x.text)
            elif inside:
                (s.closure_writes if after == "=" or after in _COMPOUND else s.uses).append(x.text)
            elif before in ("let", "var", "case") and i <= 2 or after == "=" and i == 0:
                s.defs.append(x.text)
                if before:
                    s.declared.append(x.text)
                rest = tokens[i + 1 :]
                if rest and rest[0].text == ":":
                    cut = next((k for k, y in enumerate(rest) if y.text == "="), len(rest))
                    rest = rest[cut:]
                s.value = " ".join(y.text for y in rest[1:]) if rest and rest[0].text == "=" else ""
            elif after in _COMPOUND and i == 0:
                s.defs.append(x.text)
                s.uses.append(x.text)
                s.value = ""
            else:
                s.uses.append(x.text)
        self.here().statements.append(s)


_NAME, _NUMBER = re.compile(r"[A-Za-z_]\w*"), re.compile(r"\d[\d_]*")
_LITERALS = ("true", "false", "nil")
_BINARY = ("+", "-", "*", "/", "%", "==", "!=", "<", "<=", ">", ">=", "&&", "||")


def _operand(text: str) -> tuple[str | None, str | None] | None:
    """(variable, literal) of a token."""
    if text in _LITERALS:
        return None, text
    if _NUMBER.fullmatch(text):
        return None, text.replace("_", "")
    return (text, None) if _NAME.fullmatch(text) else None


def expression(text: str) -> tuple:
    """(op, left variable, left, right variable, right) of an expression's tokens; a call if it isn't one operation at most."""
    if len(text) > 1 and text[0] == text[-1] == '"' and '"' not in text[1:-1] and "\\(" not in text:
        return None, None, text, None, None
    parts = text.split(" ")
    while len(parts) > 2 and parts[0] == "(" and parts[-1] == ")":
        parts = parts[1:-1]
    if len(parts) == 1 and (x := _operand(parts[0])):
        return None, *x, None, None
    if len(parts) == 2 and parts[0] in ("!", "-") and (x := _operand(parts[1])):
        return "!" if parts[0] == "!" else "negate", *x, None, None
    if len(parts) == 3 and parts[1] in _BINARY and (x := _operand(parts[0])) and (y := _operand(parts[2])):
        return parts[1], *x, *y
    return "call", None, None, None, None


#: Places of a block: its head, and its statements from 1 on.
PLACES = 100_000
ENTRY, EXIT = 0, 1


def rows(blocks: list[Block]) -> list[dict]:
    """The tables of a body in one list: what is flow, step, test, statement or hop (flow between statements).

    Variables that closures or ``&`` may write, or that the body doesn't declare, vary from the entry on; no store to them is judged.
    """
    escaped = {d for b in blocks for s in b.statements for d in s.closure_writes}
    own = {d for b in blocks for s in b.statements for d in s.declared}
    names = ("op", "left_var", "left", "right_var", "right")
    out = [{"what": "flow", "dst": ENTRY}]
    for d in sorted(escaped | {d for b in blocks for s in b.statements for d in s.defs if d not in own}):
        out.append({"what": "step", "block": ENTRY, "target": d, "op": "call"})
    for b in blocks:
        tested = b.condition is not None and len(b.successors) == 2 and b.kind in ("if", "guard", "while", "repeat")
        if tested:
            said = b.condition.strip("() ").strip()
            out.append({"what": "step", "block": b.id, "loop": b.kind in ("while", "repeat")} | dict(zip(names, expression(said), strict=True)))
            out.append({"what": "test", "block": b.id, "line": b.line, "target": said, "loop": b.kind == "if" and not b.has_else})
        for i, dst in enumerate(b.successors):
            out.append({"what": "flow", "block": b.id, "dst": dst, "side": ("true", "false")[i] if tested else None})
        here = b.id * PLACES
        out.append({"what": "statement", "block": here})
        for s in b.statements:
            out.append({"what": "hop", "block": here, "dst": here + 1})
            here += 1
            for d in s.defs or [None]:
                judged = d in own and d not in escaped and d not in s.uses
                out += [{"what": "statement", "block": here, "line": s.line, "target": d, "left_var": u, "loop": judged} for u in s.uses or [None]]
            out += [{"what": "step", "block": b.id, "target": d} | dict(zip(names, expression(s.value or ""), strict=True)) for d in s.defs]
        out += [{"what": "hop", "block": here, "dst": dst * PLACES} for dst in b.successors]
    return out


def of_source(body: str) -> list[Block]:
    """The blocks of a body's text."""
    return Builder([t for t in Lexer(body).tokens() if t.kind != "end"]).blocks
