"""Facts of one source file: declarations, references, string tokens and directives, from its tokens.

A tolerant walk: declarations open scopes by their braces, everything else is searched for references; what can't be
read is skipped token by token, and the file is marked degraded only if its text itself is broken. A declaration's
range runs from the line where the token before it ended to its own last line, so references on that line count as
its own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from taproot.frontend import cfg
from taproot.frontend.lexer import Lexer, Token

ACCESS = ("private", "fileprivate", "internal", "package", "public", "open")
TYPES = ("class", "struct", "enum", "protocol", "actor", "extension")
MODIFIERS = frozenset("static final override lazy weak unowned mutating nonmutating required convenience dynamic optional indirect nonisolated prefix postfix infix async distributed".split())
GLOBAL = "global"


@dataclass
class Scope:
    id: str
    kind: str
    name: str
    parent: Scope | None = None
    declaration: int | None = None

    def type_scope(self) -> Scope | None:
        at: Scope | None = self
        while at and at.kind not in TYPES:
            at = at.parent
        return at


@dataclass
class Facts:
    declarations: list[dict] = field(default_factory=list)
    references: list[dict] = field(default_factory=list)
    tokens: set[str] = field(default_factory=set)
    comments: list[tuple[int, str]] = field(default_factory=list)
    #: Tables of the bodies' control flow, with a number for each body and the function's name.
    flow: list[dict] = field(default_factory=list)
    degraded: str | None = None


class Collector:
    def __init__(self, path: str, source: str) -> None:
        self.path = path
        lexer = Lexer(source)
        self.t = lexer.tokens()
        self.facts = Facts(comments=[(c.line, c.text) for c in lexer.comments], degraded=lexer.degraded)
        self.bodies = 0
        self.scopes = 0
        self.at = 0

    # Tokens

    def peek(self, ahead: int = 0) -> Token:
        return self.t[min(self.at + ahead, len(self.t) - 1)]

    def take(self) -> Token:
        t = self.peek()
        self.at = min(self.at + 1, len(self.t) - 1)
        return t

    def closing(self, at: int) -> int:
        """The place of the bracket that closes the one at ``at``."""
        pairs, depth = {"(": ")", "[": "]", "{": "}"}, 0
        for i in range(at, len(self.t)):
            x = self.t[i].text if self.t[i].kind == "punctuation" else ""
            depth += (x in pairs) - (x in ")]}" and x != "")
            if depth == 0:
                return i
        return len(self.t) - 1

    # Facts

    def refer(self, t: Token, context: str, qualifier: str | None = None) -> None:
        self.facts.references.append({"identifier": t.text.strip("`"), "qualifier": qualifier, "line": t.line, "column": t.column, "context": context})

    def declare(self, name: str, kind: str, t: Token, scope: Scope, first: Token, head: dict, **more) -> dict:
        holder = scope.type_scope()
        row = {
            "name": name, "kind": kind, "line": t.line, "column": t.column, "first_line": first.before_line, "last_line": t.line, "access": head["access"], "modifiers": head["modifiers"],
            "attributes": head["attributes"], "conformances": more.get("conformances", []), "scope": scope.id, "enclosing": [s.declaration for s in self.chain(scope) if s.declaration is not None],
            "enclosing_type": holder.name if holder else None, "enclosing_kind": holder.kind if holder else None, "local": any(s.kind == "function" for s in self.chain(scope)), "ordinal": len(self.facts.declarations),
        }
        self.facts.declarations.append(row)
        return row

    @staticmethod
    def chain(scope: Scope | None) -> list[Scope]:
        out = []
        while scope:
            out.append(scope)
            scope = scope.parent
        return out

    def opened(self, kind: str, name: str, parent: Scope, declaration: int | None) -> Scope:
        self.scopes += 1
        return Scope(f"{self.path}:{self.scopes}", kind, name, parent, declaration)

    # Walk

    def run(self) -> Facts:
        scope = Scope(GLOBAL, "file", "")
        while self.peek().kind != "end":
            self.item(scope)
            if self.peek().text == "}":
                self.take()
        return self.facts

    def block(self, scope: Scope) -> int:
        """Items between braces; the line of the closing one."""
        self.take()
        while self.peek().kind != "end" and self.peek().text != "}":
            self.item(scope)
        return self.take().line

    def head(self) -> dict:
        head = {"access": "internal", "modifiers": [], "attributes": []}
        while True:
            t = self.peek()
            if t.kind == "attribute":
                self.take()
                head["attributes"].append(t.text[1:])
                self.refer(Token("name", t.text[1:], t.start, t.end, t.line, t.column), "attribute")
                if self.peek().text == "(" and not self.peek().space_before:
                    end = self.closing(self.at)
                    self.expressions(self.at + 1, end)
                    self.at = end + 1
            elif t.text in ACCESS:
                self.take()
                if self.peek().text == "(":
                    self.at = self.closing(self.at) + 1
                elif head["access"] == "internal":
                    head["access"] = t.text
            elif t.text in MODIFIERS or (t.text == "class" and self.peek(1).text in ("func", "var", "let", "subscript")):
                head["modifiers"].append(self.take().text)
            else:
                return head

    def item(self, scope: Scope) -> None:
        first, start = self.peek(), self.at
        head = self.head()
        t = self.peek()
        if t.text == "import":
            self.take()
            parts = []
            if self.peek().text in ("class", "struct", "enum", "protocol", "func", "var", "let", "typealias"):
                self.take()
            at = self.peek()
            while self.peek().kind in ("name", "keyword"):
                parts.append(self.take().text)
                if self.peek().text != ".":
                    break
                self.take()
            self.declare(".".join(parts), "import", at, Scope(GLOBAL, "file", ""), first, head)
        elif t.text in TYPES and self.peek(1).kind in ("name", "keyword"):
            self.type_declaration(scope, first, head)
        elif t.text in ("func", "init", "deinit", "subscript") and not (t.text == "init" and scope.kind == "function"):
            self.function(scope, first, head)
        elif t.text in ("var", "let") and (self.peek(1).kind == "name" or self.peek(1).text == "("):
            self.variables(scope, first, head)
        elif t.text == "case" and scope.kind == "enum":
            self.cases(scope, first, head)
        elif t.text in ("typealias", "associatedtype"):
            self.take()
            name = self.take()
            self.declare(name.text, t.text, name, scope, first, head)
            self.until_line_ends(name.line)
        elif t.text == "operator":
            self.take()
            name = self.take()
            self.declare(name.text, "operator", name, scope, first, head)
        elif t.text == "{":
            self.block(self.opened("block", "", scope, None))
        elif self.at > start and t.kind == "end":
            return
        else:
            self.expression_token()

    def until_line_ends(self, line: int) -> None:
        while self.peek().kind != "end" and self.peek().line == line and self.peek().text != "}":
            self.expression_token("type")

    def generics(self) -> None:
        if self.peek().text == "<":
            depth = 0
            while self.peek().kind != "end":
                t = self.peek()
                depth += (t.text == "<") - (t.text == ">")
                if t.kind == "name" and self.t[self.at - 1].text in (":", "&"):
                    self.refer(t, "inheritance")
                self.take()
                if depth == 0:
                    return

    def type_declaration(self, scope: Scope, first: Token, head: dict) -> None:
        kind = self.take().text
        name = self.take()
        text = name.text
        while kind == "extension" and self.peek().text == ".":
            self.take()
            text += "." + self.take().text
        row = self.declare(text, kind, name, scope, first, head)
        if kind == "extension":
            self.refer(name, "extension")
        self.generics()
        if self.peek().text == ":":
            self.take()
            part: list[str] = []
            while self.peek().kind != "end" and self.peek().text not in ("{", "where"):
                t = self.take()
                if t.kind == "name":
                    self.refer(t, "inheritance")
                if t.text == ",":
                    row["conformances"].append("".join(part))
                    part = []
                else:
                    part.append(t.text)
            row["conformances"].append("".join(part))
        while self.peek().kind != "end" and self.peek().text != "{":
            self.expression_token("genericConstraint")
        row["last_line"] = self.block(self.opened(kind, text, scope, row["ordinal"]))

    def function(self, scope: Scope, first: Token, head: dict) -> None:
        keyword = self.take()
        kind = {"func": "method" if scope.type_scope() else "function", "init": "initializer", "deinit": "deinitializer", "subscript": "subscript"}[keyword.text]
        name = self.take() if keyword.text == "func" else keyword
        while keyword.text == "func" and self.peek().kind == "operator" and name.kind == "operator" and not self.peek().space_before:
            name = Token("operator", name.text + self.take().text, name.start, name.end, name.line, name.column, name.before_line)
        row = self.declare(name.text, kind, name, scope, first, head)
        inner = self.opened("function", name.text, scope, row["ordinal"])
        while self.peek().text in ("?", "!"):
            self.take()
        self.generics()
        if self.peek().text == "(":
            end = self.closing(self.at)
            self.parameters(inner, end, scope)
        last = self.t[self.at - 1].line
        while self.peek().kind != "end" and self.peek().text not in ("{", "}"):
            t = self.peek()
            if t.line != last and t.text not in ("->", "where", "async", "throws", "rethrows") and self.t[self.at - 1].text not in ("->", "where", ",", ":", "&"):
                break
            last = t.line
            self.expression_token("type")
        if self.peek().text == "{":
            self.judge(self.t[self.at + 1 : self.closing(self.at)], name.text)
            last = self.block(inner)
        row["last_line"] = last

    def judge(self, body: list[Token], name: str) -> None:
        """The control flow of a body; a body over the bound is noted and left out."""
        built = cfg.Builder(body)
        if built.count > cfg.MOST_STATEMENTS:
            self.facts.degraded = self.facts.degraded or f"{name} has more than {cfg.MOST_STATEMENTS} statements"
            return
        self.bodies += 1
        self.facts.flow += [{"fn": self.bodies, "function": name} | r for r in cfg.rows(built.blocks)]

    def parameters(self, inner: Scope, end: int, scope: Scope) -> None:
        self.take()
        while self.at < end:
            first = self.peek()
            names = []
            while self.at < end and self.peek().text != ":":
                t = self.take()
                if t.kind in ("name", "keyword") and t.text not in ("inout", "isolated"):
                    names.append(t)
            if names and names[-1].text != "_" and scope.kind != "protocol":
                self.declare(names[-1].text, "parameter", names[-1], inner, first, {"access": "private", "modifiers": [], "attributes": []})
            depth = 0
            while self.at < end:
                t = self.peek()
                if t.text == "," and depth == 0:
                    self.take()
                    break
                depth += (t.text in ("(", "[", "<", "{")) - (t.text in (")", "]", ">", "}"))
                self.expression_token("type")
        self.at = end + 1

    def variables(self, scope: Scope, first: Token, head: dict) -> None:
        keyword = self.take().text
        kind = "constant" if keyword == "let" else "variable"
        rows: list[dict] = []
        while True:
            t = self.peek()
            if t.text == "(":
                self.at = self.closing(self.at) + 1
            elif t.kind == "name":
                self.take()
                rows.append(self.declare(t.text.strip("`"), kind, t, scope, first, head))
            else:
                break
            depth, context = 0, "type" if self.peek().text == ":" else "read"
            last = t.line
            while self.peek().kind != "end":
                x = self.peek()
                if depth == 0 and (x.text in (",", "}", ";") or x.text == "{" and scope.kind == "block"):
                    break
                if depth == 0 and x.line != last and x.text not in ("=", "{", ".", "?", ":") and x.kind != "operator" and self.t[self.at - 1].kind != "operator" and self.t[self.at - 1].text not in (",", "(", "[", ":", ".", "="):
                    break
                if x.text == "{" and depth == 0:
                    last = self.block(self.opened("function" if scope.kind != "function" else "block", t.text, scope, rows[-1]["ordinal"] if rows else None))
                    continue
                if depth == 0 and x.text in ("else", "in", "where"):
                    break
                depth += (x.text in ("(", "[")) - (x.text in (")", "]"))
                if depth < 0:
                    break
                context = "read" if x.text == "=" else context
                last = x.line
                self.expression_token(context)
            for r in rows:
                r["last_line"] = max(r["last_line"], last)
            if self.peek().text != ",":
                break
            self.take()

    def cases(self, scope: Scope, first: Token, head: dict) -> None:
        self.take()
        owner = next((d for d in reversed(self.facts.declarations) if d["ordinal"] == scope.declaration), None)
        while self.peek().kind in ("name", "keyword"):
            t = self.take()
            row = self.declare(t.text.strip("`"), "enumCase", t, scope, first, head | {"access": owner["access"] if owner else "internal"}, conformances=list(owner["conformances"]) if owner else [])
            if self.peek().text == "(":
                end = self.closing(self.at)
                self.expressions(self.at + 1, end, "type")
                self.at = end + 1
            if self.peek().text == "=":
                self.take()
                self.expression_token()
            row["last_line"] = self.t[self.at - 1].line
            if self.peek().text != ",":
                return
            self.take()

    def expressions(self, first: int, end: int, context: str = "read") -> None:
        self.at = first
        while self.at < end:
            self.expression_token(context)

    def expression_token(self, context: str = "read") -> None:
        """One token of an expression or type: references in it, nested closures and string literals."""
        before, t, after = self.t[self.at - 1] if self.at else None, self.take(), self.peek()
        if t.kind == "string":
            for s in t.segments:
                self.facts.tokens |= {x for x in re.split(r"[^\w]+", s) if x and not x[0].isdigit()}
            own, place = self.t, self.at
            self.t, self.at = [*t.inner, Token("end", "", t.end, t.end, t.line, t.column)], 0
            while self.peek().kind != "end":
                self.expression_token()
            self.t, self.at = own, place
        elif t.text == "{":
            self.at -= 1
            self.block(Scope(f"{self.path}:closure", "block", "", None))
        elif t.kind == "name" and t.text != "_":
            label = after.text == ":" and before is not None and before.text in ("(", ",") and context != "type"
            if label:
                return
            member = before is not None and before.text == "." and not before.space_before
            if context == "type":
                self.refer(t, "typeAnnotation", self.t[self.at - 3].text if member and self.at >= 3 else None)
            elif after.text == "=":
                self.refer(t, "write")
            elif after.text == "(" and not after.space_before:
                self.refer(t, "call")
            else:
                self.refer(t, "memberAccessMember" if member else "read")


def collect(path: str, source: str) -> Facts:
    return Collector(path, source).run()
