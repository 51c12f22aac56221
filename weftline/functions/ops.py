"""The operations that mapping steps name, as Column expressions.

The source vocabulary is documentation only; executing it is an extension of this library. Semantics follow the mapped
language: null text is empty for trim, trailing empty parts of a split are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim(c: Column) -> Column:
    """Without control characters and spaces at both ends; null becomes empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def split(c: Column, pattern: str) -> Column:
    """Parts between matches of the pattern, without empty ones at the end."""
    parts = F.split(c, pattern)
    full = F.transform(parts, lambda x, i: F.when(F.length(x) > 0, i + 1).otherwise(0))
    return F.slice(parts, F.lit(1), F.greatest(F.array_max(full), F.when(F.size(parts) == 1, 1).otherwise(0)))


def take_first(a: Column) -> Column:
    return F.get(a, F.lit(0))


def take_last(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.element_at(a, -1))


def take_index(a: Column, i: int) -> Column:
    """The part at index i from 0; null beyond the end."""
    return F.get(a, F.lit(i))


def multiply(c: Column, by: float) -> Column:
    return c * F.lit(by)


def add(c: Column, n: float) -> Column:
    return c + F.lit(n)


def subtract(c: Column, n: float) -> Column:
    return c - F.lit(n)


def divide(c: Column, by: float) -> Column:
    """Quotient; null for a divisor of 0."""
    return F.try_divide(c, F.lit(by))


def whole(c: Column) -> Column:
    """A number cut toward zero to 64 bits, at most their bounds."""
    return F.when(c >= 2.0**63, F.lit(2**63 - 1)).when(c <= -(2.0**63), F.lit(-(2**63))).otherwise(c.try_cast("long"))


def join(*parts: Column, sep: str = " ") -> Column:
    """Parts with the separator between them; null parts are left out."""
    return F.concat_ws(sep, *parts)


def letters_only(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}]", "")


def keep_digits(c: Column) -> Column:
    """Digits and hyphens."""
    return F.regexp_replace(c, r"[^\p{Nd}-]", "")


def mask(c: Column, n: int = 4) -> Column:
    """The first n characters become asterisks."""
    return F.concat(F.repeat(F.lit("*"), F.least(F.lit(n), F.length(c))), F.substring(c, n + 1, 2**31 - 1))


def round_to(c: Column, n: int = 2) -> Column:
    return F.round(c, n)


#: Operation names in steps, lower-cased, and how they apply to a column and the step's value.
OPS: dict[str, Callable[[Column, str | None], Column]] = {
    "trim": lambda c, v: trim(c),
    "split": lambda c, v: split(c, v if v is not None else r"\s+"),
    "takefirst": lambda c, v: take_first(c),
    "takelast": lambda c, v: take_last(c),
    "takeindex": lambda c, v: take_index(c, int(v or 0)),
    "multiply": lambda c, v: multiply(c, float(v or 1)),
    "add": lambda c, v: add(c, float(v or 0)),
    "subtract": lambda c, v: subtract(c, float(v or 0)),
    "divide": lambda c, v: divide(c, float(v or 1)),
    "uppercase": lambda c, v: F.upper(c),
    "lowercase": lambda c, v: F.lower(c),
    "join": lambda c, v: F.array_join(c, v if v is not None else " "),
    "lettersonly": lambda c, v: letters_only(c),
    "keepdigits": lambda c, v: keep_digits(c),
    "mask": lambda c, v: mask(c, int(v or 4)),
    "round": lambda c, v: round_to(c, int(v or 2)),
}

#: Conditions of filter steps.
CONDITIONS: dict[str, Callable[[Column, Column], Column]] = {
    "equals": lambda c, v: c == v,
    "not equals": lambda c, v: c != v,
    "contains": lambda c, v: F.contains(c, v),
    "greater than": lambda c, v: c > v,
    "less than": lambda c, v: c < v,
}


def select_match(items: Column, keep: Callable[[Column], Column], which: str) -> Column:
    """First match, Last match or All matches of an array."""
    found = F.filter(items, keep)
    return {"First match": F.get(found, F.lit(0)), "Last match": F.when(F.size(found) > 0, F.element_at(found, -1)), "All matches": found}[which]


def compile_steps(steps: list[dict], columns: dict[str, Column]) -> Column:
    """One field's steps as a Column: READ, TRANSFORM, FILTER (with its CONSTANT or TRANSFORM), CONSTANT, BUILD, WRITE.

    A filter guards what follows it up to the next filter; later steps without a filter are the default. RAW can't run.
    """
    now: Column | None = None
    branches: list[tuple[Column, Column]] = []
    guard: Column | None = None
    for s in steps:
        kind, meta = s["kind"].upper(), s.get("meta") or {}
        if kind == "READ":
            now = columns[s["sourceField"]]
        elif kind == "TRANSFORM":
            now = OPS[str(meta["op"]).lower()](now if now is not None else columns[s["sourceField"]], None if meta.get("value") is None else str(meta["value"]))
            if guard is not None:
                branches.append((guard, now))
        elif kind == "FILTER":
            name = next((k for k in sorted(CONDITIONS, key=len, reverse=True) if s["condition"].lower().startswith(k)), None)
            if name is None:
                raise ValueError(f"unknown condition: {s['condition']}")
            guard = CONDITIONS[name](now if s.get("sourceField") is None else columns[s["sourceField"]], F.lit(s["condition"][len(name) :].strip()))
        elif kind == "CONSTANT":
            value = F.lit(meta.get("value", s.get("value")))
            if guard is None:
                now = value
            else:
                branches.append((guard, value))
                now = None
            guard = None
        elif kind == "BUILD":
            now = F.struct(*[columns[f].alias(f) for f in meta["fields"]])
        elif kind not in ("WRITE", "SELECT"):
            raise ValueError(f"a {kind} step can't run")
    out = now if now is not None else F.lit(None)
    for test, value in reversed(branches):
        out = F.when(test, value).otherwise(out)
    return out
