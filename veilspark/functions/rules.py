"""Compiled rules with a literal guard each, and the scan of one text."""

from __future__ import annotations

import re._parser as parser
from dataclasses import dataclass
from functools import cache

import regex

from veilspark.functions import shapes
from veilspark.functions.catalogue import CONTEXT_WINDOW, RULES, Rule
from veilspark.functions.validators import VALIDATORS


def required(pattern: str) -> frozenset[str] | None:
    """Literals of which every match of the pattern contains one, or None if that can't be told.

    Read from the pattern's syntax tree: a sequence needs what any of its parts needs (the longest is kept), an alternation
    needs what each branch needs, a repetition at least once what its body needs.
    """

    def of(items) -> frozenset[str] | None:
        best: frozenset[str] | None = None
        run = ""

        def better(new: frozenset[str] | None) -> None:
            nonlocal best
            if new and all(new) and (best is None or (min(map(len, new)), -len(new)) > (min(map(len, best)), -len(best))):
                best = new

        for op, arg in [*items, (None, None)]:
            name = str(op)
            if name == "LITERAL":
                run += chr(arg)
                continue
            if run:
                better(frozenset({run}))
                run = ""
            if name == "SUBPATTERN":
                better(of(arg[3]))
            elif name == "BRANCH":
                parts = [of(branch) for branch in arg[1]]
                if all(parts):
                    better(frozenset().union(*parts))
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
                better(of(arg[2]))
            elif name == "ATOMIC_GROUP":
                better(of(arg))
        return best

    try:
        return of(parser.parse(pattern))
    except Exception:  # a construct the parser does not know: no guard
        return None




@dataclass(frozen=True)
class Compiled:
    rule: Rule
    order: int
    pattern: regex.Pattern
    literals: tuple[str, ...]
    least_digits: int


@cache
def compiled() -> tuple[Compiled, ...]:
    """All rules in order. An unknown validator or a bad pattern is an error here, before any task runs."""
    out = []
    for k, rule in enumerate(RULES):
        if rule.validate is not None and rule.validate not in VALIDATORS:
            raise ValueError(f"rule {rule.name}: no validator {rule.validate!r}")
        names = {"i": regex.IGNORECASE, "m": regex.MULTILINE, "s": regex.DOTALL, "u": regex.UNICODE}
        flags = 0
        for letter in rule.flags:
            flags |= names.get(letter, 0)
        try:
            pattern = regex.compile(rule.pattern, flags)
        except regex.error as e:
            raise ValueError(f"rule {rule.name}: {e}") from e
        words = required(rule.pattern) or ()
        out.append(Compiled(rule, k, pattern, tuple(sorted(w.casefold() for w in words if len(w) > 1)) if all(len(w) > 1 for w in words) else (), _least_digits(rule.pattern)))
    return tuple(out)


def _least_digits(pattern: str) -> int:
    """A number of digits that every match has at least."""

    def of(items) -> int:
        n = 0
        for op, arg in items:
            name = str(op)
            if name == "IN":
                n += all(str(o) == "RANGE" and 48 <= a[0] and a[1] <= 57 or str(o) == "CATEGORY" and str(a) == "CATEGORY_DIGIT" or str(o) == "LITERAL" and 48 <= a <= 57 for o, a in arg)
            elif name == "LITERAL":
                n += 48 <= arg <= 57
            elif name == "SUBPATTERN":
                n += of(arg[3])
            elif name == "BRANCH":
                n += min(of(b) for b in arg[1])
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                n += arg[0] * of(arg[2])
        return n

    try:
        return of(parser.parse(pattern))
    except Exception:
        return 0


@dataclass(frozen=True)
class Match:
    rule: str
    description: str
    category: str
    start: int
    end: int
    value: str
    rule_ord: int
    match_ord: int


def _kept(one: Compiled, text: str, m: regex.Match) -> bool:
    rule, whole = one.rule, m[0]
    value = m[rule.group] if rule.group is not None else whole
    if not value:
        return False
    if rule.category == "secret":
        seen = {"value": value, "whole": whole}
        following = text[m.end() : m.end() + 64]
        if any(shapes.has_shape(seen[of], name, following) for of, name, grouped in shapes.SECRET_GATES if rule.group is not None or not grouped):
            return False
    if rule.least_entropy is not None and shapes.entropy(value) < rule.least_entropy:
        return False
    if rule.validate is not None and not VALIDATORS[rule.validate](value):
        return False
    reach = CONTEXT_WINDOW if rule.window is None else rule.window
    if rule.needs_context and not shapes.near(text, m.start(), m.end(), rule.context, reach):
        return False
    return not (rule.without and shapes.near(text, m.start(), m.end(), rule.without, reach))


def scan_text(text: str | None) -> list[Match]:
    """All matches by start, then rule, then place. Null and empty texts have none.

    A rejected match still uses up its stretch; the span is that of the captured group, the context that of the whole match.
    """
    if not text:
        return []
    low = text.casefold()
    n_digits = sum(map(str.isdigit, text))
    found = []
    for one in compiled():
        if one.least_digits > n_digits or one.literals and not any(w in low for w in one.literals):
            continue
        rule = one.rule
        for k, m in enumerate(one.pattern.finditer(text)):
            if _kept(one, text, m):
                group = rule.group or 0
                found.append(Match(rule.name, rule.description, rule.category, m.start(group), m.end(group), m[group], one.order, k))
    return sorted(found, key=lambda f: (f.start, f.rule_ord, f.match_ord))
