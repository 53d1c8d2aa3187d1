"""Rule conditions as data: tests of one field each, and clauses of tests.

A condition becomes clauses: all of them must hold, and a clause holds if one of its tests does (or, negated, does not).
Rules are configuration, so this runs on the driver; ``rule_index`` puts the clauses into a table.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product
from math import prod

from tracewarden.functions import fixed
from tracewarden.schema import EVENT_COLUMNS

# A condition of more clauses is left to compiled Columns.
MOST_CLAUSES = 64


class RuleError(ValueError):
    """A rule that cannot be compiled; the message says why."""


def wildcard_regex(text: str) -> str:
    """``*``, ``?`` and ``[...]`` over the whole value as a Java regular expression."""
    out, i = [], 0
    while i < len(text):
        ch = text[i]
        close = text.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif close > 0:
            inside = text[i + 1:close].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("[" + ("^" + inside[1:] if inside.startswith("!") else re.sub(r"^\^", r"\\^", inside)) + "]")
            i = close
        else:
            out.append(re.escape(ch))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def check_regex(pattern: str) -> str:
    """Reject what the JVM dialect lacks, with a message at load time."""
    try:
        re.compile(pattern)
    except re.error as ex:
        raise RuleError(f"invalid regular expression {pattern!r}: {ex}") from ex
    if "(?P<" in pattern or "(?P=" in pattern or "(?(" in pattern:
        raise RuleError(f"unsupported regular expression construct in {pattern!r}")
    return pattern


def field_columns(name: str) -> tuple[str, ...]:
    """The event columns that may hold a rule field, first one first; after them comes ``name=value`` in the payload."""
    mapped = fixed.SIGMA_FIELDS.get(name)
    own = (name,) if name in EVENT_COLUMNS and mapped != name else ()
    return ((mapped,) if mapped else ()) + own


@dataclass(frozen=True)
class Test:
    columns: tuple[str, ...]
    name: str | None  # looked for in the payload where the columns are null
    op: str
    text: str

    __test__ = False

    def literal(self) -> str | None:
        """A text that the lower-cased payload must contain for this test to hold, if there is one."""
        if self.columns not in ((), ("raw_payload",)):
            return None
        text = self.text
        if self.op == "like":
            text = max(re.split(r"[*?]", text), key=len) if "[" not in text else ""
        elif self.op not in ("eq", "contains", "starts", "ends"):
            return None
        # Lower case of a part is that part of the lower case for ASCII only.
        return text if len(text) >= 3 and text.isascii() else None


class Tests:
    """Detections as trees: ("all" | "any", parts), ("not", part), ("test", Test), or ("other",) for what is no such test."""

    def all(self, parts):
        return ("all", list(parts))

    def any(self, parts):
        return ("any", list(parts))

    def negated(self, part):
        return ("not", part)

    def keyword(self, word: str):
        return ("test", Test(("raw_payload",), None, "contains", word))

    def one_of(self, column: str, *values: str):
        return self.any(("test", Test((column,), None, "eq", v)) for v in values)

    def at_least(self, need: int, parts: Sequence):
        if need <= 0 or need == len(parts):
            return self.all(parts if need > 0 else [])
        if need == 1 or need > len(parts):
            return self.any(parts if need == 1 else [])
        return ("other",)

    def value(self, name: str, value, modifiers: Sequence[str]):
        text = "null" if value is None else str(value)
        if "cidr" in modifiers:
            return ("other",)
        low = text.lower()
        if "re" in modifiers:
            op, text = "re", "(?i)" + check_regex(text)
        else:
            words = (("contains", "contains"), ("startswith", "starts"), ("endswith", "ends"))
            op = next((o for m, o in words if m in modifiers), None)
            if op is None:
                op = "null" if low == "null" else "like" if "*" in low or "?" in low else "eq"
            text = low
        return ("test", Test(field_columns(name), name, op, text))


TESTS = Tests()
Clause = list[tuple[Test, bool]]


def clauses(tree, yes: bool = True) -> list[Clause] | None:
    """The clauses of a tree (of its negation if not ``yes``), or None if it has other parts or would need too many."""
    kind, *rest = tree
    if kind == "test":
        return [[(rest[0], not yes)]]
    if kind == "not":
        return clauses(rest[0], not yes)
    if kind == "other":
        return None
    parts = [clauses(p, yes) for p in rest[0]]
    if any(p is None for p in parts):
        return None
    if (kind == "all") == yes:
        out = [c for p in parts for c in p]
    elif prod(map(len, parts)) > MOST_CLAUSES:
        return None
    else:
        out = [[t for c in choice for t in c] for choice in product(*parts)]
    return out if len(out) <= MOST_CLAUSES else None
