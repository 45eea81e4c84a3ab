"""A tolerant lexer for Swift source: every byte belongs to a token or to the trivia before one.

Lines and columns count from 1, columns in UTF-8 bytes. Strings keep the texts of their literal segments and the
tokens of their interpolations.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field


@dataclass
class Token:
    kind: str  # name, keyword, number, string, operator, punctuation, attribute, pound, end
    text: str
    start: int
    end: int
    line: int
    column: int
    #: Where the token before ended, and this one with the trivia on its own line.
    before_line: int = 1
    segments: list[str] = field(default_factory=list)
    inner: list[Token] = field(default_factory=list)
    space_before: bool = False


@dataclass
class Comment:
    text: str
    line: int
    end_line: int


KEYWORDS = frozenset(
    """actor as associatedtype async await break case catch class continue default defer deinit do else enum extension fallthrough false
    fileprivate final for func guard if import in indirect init inout internal is lazy let mutating nil nonisolated nonmutating open operator
    override package private protocol public repeat required rethrows return self Self static struct subscript super switch throw throws true try
    typealias unowned var weak where while""".split()
)
_OPERATOR = "/=-+!*%<>&|^~?"
_NAME = re.compile(r"[^\W\d]\w*|`[^`\n]+`|\$\d+|\$[^\W\d]\w*")
_NUMBER = re.compile(r"0x[0-9a-fA-F_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?")
_SPACE = re.compile(r"\s+")


class Lexer:
    def __init__(self, source: str, base: int = 0, lines: list[int] | None = None) -> None:
        self.source, self.base = source, base
        self.lines = lines or [0, *(m.end() for m in re.finditer("\n", source))]
        self.comments: list[Comment] = []
        self.degraded: str | None = None

    def place(self, at: int) -> tuple[int, int]:
        line = bisect_right(self.lines, at)
        return line, len(self.source[self.lines[line - 1] : at].encode()) + 1

    def _trivia(self, at: int, stop: int) -> int:
        s = self.source
        while at < stop:
            if s[at].isspace():
                at = min(stop, _SPACE.match(s, at).end())
            elif s.startswith("//", at):
                end = s.find("\n", at, stop)
                end = stop if end < 0 else end
                line = self.place(at)[0]
                self.comments.append(Comment(s[at:end], line, line))
                at = end
            elif s.startswith("/*", at):
                depth, end = 1, at + 2
                while end < stop and depth:
                    if s.startswith("/*", end):
                        depth, end = depth + 1, end + 2
                    elif s.startswith("*/", end):
                        depth, end = depth - 1, end + 2
                    else:
                        end += 1
                if depth:
                    self.degraded = "a block comment doesn't end"
                self.comments.append(Comment(s[at:end], self.place(at)[0], self.place(end)[0]))
                at = end
            elif s.startswith("#!", at) and at == 0:
                end = s.find("\n", at, stop)
                at = stop if end < 0 else end
            else:
                break
        return at

    def _string(self, at: int, stop: int) -> tuple[int, list[str], list[Token]]:
        """A literal from ``at``: its end, literal segments, and interpolated tokens."""
        s, hashes = self.source, 0
        while s.startswith("#", at):
            hashes, at = hashes + 1, at + 1
        quote = '"""' if s.startswith('"""', at) else '"'
        at += len(quote)
        close, escape = quote + "#" * hashes, "\\" + "#" * hashes
        segments, inner, text = [], [], []
        while at < stop:
            if s.startswith(close, at):
                segments.append("".join(text))
                return at + len(close), segments, inner
            if s.startswith(escape, at):
                at += len(escape)
                if s.startswith("(", at):
                    segments.append("".join(text))
                    text = []
                    tokens, at = self._until_close(at + 1, stop)
                    inner += tokens
                else:
                    text.append(" ")
                    at += 1
            elif s[at] == "\n" and quote == '"':
                break
            else:
                text.append(s[at])
                at += 1
        self.degraded = "a string doesn't end"
        segments.append("".join(text))
        return at, segments, inner

    def _until_close(self, at: int, stop: int) -> tuple[list[Token], int]:
        depth, out = 1, []
        while True:
            t = self._next(at, stop)
            if t.kind == "end":
                return out, stop
            depth += (t.text == "(") - (t.text == ")")
            if not depth:
                return out, t.end
            out.append(t)
            at = t.end

    def _next(self, at: int, stop: int) -> Token:
        s = self.source
        first = at
        at = self._trivia(at, stop)
        line, column = self.place(at)
        make = lambda kind, end, **more: Token(kind, s[at:end], at, end, line, column, before_line=self.place(first)[0], space_before=at > first, **more)
        if at >= stop:
            return make("end", at)
        c = s[at]
        if c == '"' or re.match(r'#+"', s[at : at + 20]):
            end, segments, inner = self._string(at, stop)
            return make("string", end, segments=segments, inner=inner)
        if m := _NAME.match(s, at):
            return make("keyword" if m[0] in KEYWORDS else "name", m.end())
        if m := _NUMBER.match(s, at):
            return make("number", m.end())
        if c == "@" and (m := _NAME.match(s, at + 1)):
            return make("attribute", m.end())
        if c == "#" and (m := _NAME.match(s, at + 1)):
            return make("pound", m.end())
        if c in _OPERATOR:
            end = at
            while end < stop and s[end] in _OPERATOR + "." and not (s[end] == "." and s[at] != "."):
                if end > at and (s.startswith("//", end) or s.startswith("/*", end)):
                    break
                end += 1
            if s[at] in "?!<>&" and s[at:end] not in ("??", "&&", "<=", ">=", "!=", "!==", "<<", "&+", "&-", "&*", "&=", "??="):
                end = at + 1
            return make("operator", end)
        if s.startswith("...", at) or s.startswith("..<", at):
            return make("operator", at + 3)
        return make("punctuation", at + 1)

    def tokens(self) -> list[Token]:
        out, at = [], 0
        while True:
            t = self._next(at, len(self.source))
            out.append(t)
            if t.kind == "end":
                return out
            at = t.end
