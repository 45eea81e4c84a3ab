"""Scalar functions over names, paths, patterns and comments."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def identifier_tokens(text: Column, ascii_only: bool = False) -> Column:
    """Maximal runs of letters, digits and ``_`` whose first character is a letter or ``_``; other runs go whole."""
    cut, first = (r"[^A-Za-z0-9_]+", r"^[A-Za-z_]") if ascii_only else (r"[^\p{L}\p{N}_]+", r"^[\p{L}_]")
    return F.filter(F.split(text, cut), lambda t: t.rlike(first))


def base_name(name: Column) -> Column:
    """A type name without module qualifier and generic arguments."""
    return F.element_at(F.split(F.substring_index(F.trim(name), "<", 1), r"\."), -1)


def is_operator_name(name: Column) -> Column:
    return ~name.rlike(r"^[\p{L}_`]")


# Built-in type names that never count as uses of a declared type.
BUILT_IN_TYPES = frozenset(
    "Int Int8 Int16 Int32 Int64 UInt UInt8 UInt16 UInt32 UInt64 Float Double Bool String Character Void Any AnyObject Never Self Array Dictionary Set Optional Result Error Data Date URL UUID Decimal Sequence Collection Range Substring Type".split()
)


def annotation_types(annotation: Column) -> Column:
    """Capitalised names in a type annotation, without built-in ones."""
    names = F.split(F.regexp_replace(annotation, r"[?!]", ""), r"[\[\]<>,:()\s]+|->")
    return F.array_distinct(F.filter(names, lambda n: n.rlike(r"^\p{Lu}") & ~n.isin(*sorted(BUILT_IN_TYPES))))


def glob_regex(pattern: str) -> str:
    """``**/`` is any folders, ``**`` anything, ``*`` anything but ``/``, ``?`` one character but ``/``; anchored."""
    parts = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(parts.get(t) or re.escape(t) for t in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", pattern)) + "$"


def glob_match(path: Column, pattern: str) -> Column:
    return path.rlike(glob_regex(pattern))


#: A pattern may have so many bytes.
PATTERN_BYTES = 512
_NESTED = re.compile(r"\((?:[^()\\]|\\.)*[*+](?:[^()\\]|\\.)*\)[*+{]")


def safe_pattern(pattern: str) -> str | None:
    """The pattern, or None if it is too long, has nested quantifiers, or isn't a pattern."""
    if len(pattern.encode()) > PATTERN_BYTES or _NESTED.search(pattern):
        return None
    try:
        re.compile(pattern)
    except re.error:
        return None
    return pattern


def matches_any(name: Column, patterns: list[str]) -> Column:
    """Whether any safe pattern is found; a rejected pattern matches nothing."""
    found = F.lit(False)
    for p in filter(None, map(safe_pattern, patterns)):
        found = found | name.rlike(p)
    return found


def excluded(path: Column, entries: list[str]) -> Column:
    """An entry with wild cards is an anchored glob, another a substring; an empty one matches nothing."""
    found = F.lit(False)
    for e in filter(None, entries):
        found = found | (glob_match(path, e) if set(e) & set("*?") else path.contains(e))
    return found


def has_component(path: Column, name: str) -> Column:
    return F.array_contains(F.split(path, "/"), name)


def is_test_path(path: Column) -> Column:
    return has_component(path, "Tests") | path.endswith("Tests.swift")


VERBS = ("accept", "accept-next", "disable", "enable", "expect")


def directive(comment: Column, rules: list[str], prefix: str = "tr") -> Column:
    """struct(verb, rules, reason) of a comment ``// @tr:verb rule, rule -- reason``, or null.

    Documentation comments never are directives. A directive that names only unknown rules is null; without rules it
    holds for all.
    """
    body = F.regexp_extract(comment, rf"^\s*(?://(?!/)|/\*(?!\*))\s*@{prefix}:(.*?)(?:\*/)?\s*$", 1)
    verb = F.regexp_extract(body, r"^([a-z-]+)", 1)
    rest = F.regexp_extract(body, r"^[a-z-]+\s*(.*)$", 1)
    reason = F.nullif(F.trim(F.regexp_extract(rest, r"--\s*(.*)$", 1)), F.lit(""))
    named = F.filter(F.split(F.regexp_replace(rest, r"--.*$", ""), r"[,\s]+"), lambda r: r != "")
    known = F.filter(named, lambda r: r.isin(*rules))
    valid = verb.isin(*VERBS) & ((F.size(named) == 0) | (F.size(known) > 0))
    return F.when(valid, F.struct(verb.alias("verb"), known.alias("rules"), reason.alias("reason")))


def relative_path(path: Column, root: str) -> Column:
    """A path below a root without it; other paths as they are."""
    prefix = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(prefix)), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)
