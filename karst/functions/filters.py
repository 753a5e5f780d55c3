"""Filter languages compiled to Columns: tag expressions and metadata dictionaries."""

from __future__ import annotations

import re
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:([&|!()])|([^\s&|!()][^&|!()]*?)(?=\s*[&|!()]|\s*$))")


class TagSyntaxError(ValueError):
    """The tag expression can't be read."""


class _Tags:
    """Recursive descent over `|`, `&`, `!` and brackets; `!` binds tightest, `|` weakest."""

    def __init__(self, text: str, has):
        self.items: list[str] = []
        at = 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise TagSyntaxError(f"at {at}: {text!r}")
            self.items.append(m[1] or m[2].strip())
            at = m.end()
        self.at, self.has, self.text = 0, has, text

    def peek(self) -> str | None:
        return self.items[self.at] if self.at < len(self.items) else None

    def take(self) -> str:
        self.at += 1
        return self.items[self.at - 1]

    def whole(self) -> Column:
        out = self.either()
        if self.peek() is not None:
            raise TagSyntaxError(f"unexpected {self.peek()!r} in {self.text!r}")
        return out

    def either(self) -> Column:
        out = self.both()
        while self.peek() == "|":
            self.take()
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.one()
        while self.peek() == "&":
            self.take()
            out = out & self.one()
        return out

    def one(self) -> Column:
        token = self.peek()
        if token is None or token in "&|)":
            raise TagSyntaxError(f"a tag is missing in {self.text!r}")
        self.take()
        if token == "!":
            return ~self.one()
        if token == "(":
            out = self.either()
            if self.peek() != ")":
                raise TagSyntaxError(f"a bracket stays open in {self.text!r}")
            self.take()
            return out
        return self.has(token)


def tag_filter(expression: str | list[str] | None, tags: Column | str = "tags") -> Column:
    """Column of a tag expression, or of a list of tags that must all be there.

    Null, empty and blank filters keep every row. Null tags count as none, so a negation
    keeps untagged rows. A leading `name:` is a prefix of the field and is left out.
    """
    column = F.coalesce(F.col(tags) if isinstance(tags, str) else tags, F.array().cast("array<string>"))
    has = lambda tag: F.array_contains(column, tag)
    if isinstance(expression, list):
        return reduce(lambda a, b: a & b, map(has, expression), F.lit(True))
    if expression is None or not expression.strip():
        return F.lit(True)
    return _Tags(re.sub(r"^\s*\w+\s*:", "", expression), has).whole()


_ISO = re.compile(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?.*)?$")


def metadata_filter(conditions: dict[str, Any] | None, column=F.col) -> Column:
    """Conjunction of field conditions: a plain value, or {$eq, $ne, $gt, $gte, $lt, $lte, $in, $nin}.

    $eq, and else $ne, stands alone in its dictionary. ISO dates are compared as
    timestamps. `column` maps a field name to its Column. Nothing given keeps every row.
    """
    out = F.lit(True)
    for field, want in (conditions or {}).items():
        out = out & _condition(column(field), want)
    return out


def _condition(c: Column, want: Any) -> Column:
    if not isinstance(want, dict):
        return c.eqNullSafe(F.lit(want)) if want is None else c == F.lit(want)
    if "$eq" in want:
        return c == F.lit(want["$eq"])
    if "$ne" in want:
        return ~c.eqNullSafe(F.lit(want["$ne"]))
    out = F.lit(True)
    for op, value in want.items():
        left, right = (c, F.lit(value)) if op in ("$in", "$nin") or not (isinstance(value, str) and _ISO.match(value)) else (c.try_cast("timestamp"), F.lit(value).cast("timestamp"))
        match op:
            case "$gt":
                out = out & (left > right)
            case "$gte":
                out = out & (left >= right)
            case "$lt":
                out = out & (left < right)
            case "$lte":
                out = out & (left <= right)
            case "$in":
                out = out & c.isin(list(value))
            case "$nin":
                out = out & ~F.coalesce(c.isin(list(value)), F.lit(False))
            case _:
                raise ValueError(f"operator {op!r} is not known")
    return out


def date_or_undated(rows, dates: Column, first: str, last: str):
    """Rows with a date in [first, last] or with none; all rows if that leaves nothing."""
    keep = F.exists(dates, lambda d: d.between(F.lit(first).cast("date"), F.lit(last).cast("date"))) | (F.size(dates) <= 0)
    kept = rows.where(F.coalesce(keep, F.lit(True)))
    return rows if kept.isEmpty() else kept


def any_word(columns: list[Column], words: list[str], most: int = 5, longer_than: int = 3) -> Column:
    """Case-insensitive containment of any of the first `most` longer words in any column."""
    chosen = [w for w in words if len(w) > longer_than][:most]
    tests = [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(w.lower())) for c in columns for w in chosen]
    return reduce(lambda a, b: a | b, tests, F.lit(False))
