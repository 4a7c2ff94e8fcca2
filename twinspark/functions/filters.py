"""The filter mini-language, compiled to one Catalyst predicate."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The prefixes that open a condition.
PREFIXES = ("mime:", "name:", "size:", "origin:", "tag:", "accepted:", "date:", "after:", "before:", "case:")
_OPENS = re.compile(rf"(?:^|(?<=[ \t\n\r\f]))!?(?={'|'.join(PREFIXES)})")
_SIZE = re.compile(r"(>=|<=|>|<|=)?\s*(\d+)$")


class FilterError(ValueError):
    """The expression is not one of the mini-language."""


@dataclass(frozen=True)
class Condition:
    kind: str
    value: str
    negated: bool = False


@dataclass(frozen=True)
class FileFilter:
    conditions: tuple[Condition, ...] = ()
    ignore_case: bool = False

    @property
    def uses_tags(self) -> bool:
        return any(c.kind == "tag" for c in self.conditions)

    @property
    def uses_accepted(self) -> bool:
        return any(c.kind == "accepted" for c in self.conditions)


def parse(text: str | None) -> FileFilter:
    """Conditions joined by AND; a blank text is the filter that lets all through."""
    text = (text or "").strip()
    if not text:
        return FileFilter()
    at = [m.start() for m in _OPENS.finditer(text)]
    if not at or at[0]:
        if re.match(r"!\s", text) or text == "!":
            return FileFilter((Condition("nothing", ""),))
        raise FilterError(f"unknown condition: {text.split()[0]}")
    found, ignore_case = [], False
    for a, b in zip(at, [*at[1:], len(text)], strict=True):
        part = text[a:b].strip()
        negated = part.startswith("!")
        kind, _, value = part.removeprefix("!").partition(":")
        if kind == "case":
            if negated or value not in ("insensitive", "sensitive"):
                raise FilterError(f"unknown case mode: {part}")
            ignore_case = value == "insensitive"
            continue
        if value.endswith(" !") or value == "!":
            found.append(Condition("nothing", ""))
            value = value.removesuffix("!").strip()
        if kind == "size" and not _SIZE.match(value):
            raise FilterError(f"bad size: {value}")
        if kind == "accepted" and value.lower() not in ("yes", "no", "true", "false", "1", "0"):
            raise FilterError(f"bad accepted: {value}")
        if kind in ("date", "after", "before"):
            date_span(value)
        found.append(Condition(kind, value, negated))
    return FileFilter(tuple(found), ignore_case)


def date_span(value: str) -> tuple[int, int]:
    """Half-open span, in milliseconds, of a year, month or day; days past a month's end roll over."""
    m = re.fullmatch(r"(-?\d{1,6})(?:-(\d{1,2}))?(?:-(\d{1,2}))?", value)
    if not m:
        raise FilterError(f"bad date: {value}")
    year, month, day = int(m[1]), m[2] and int(m[2]), m[3] and int(m[3])
    if (month is not None and not 1 <= month <= 12) or (day is not None and not 1 <= day <= 31) or not 1 <= year <= 9998:
        raise FilterError(f"bad date: {value}")
    first = dt.datetime(year, month or 1, 1, tzinfo=dt.UTC) + dt.timedelta(days=(day or 1) - 1)
    if day:
        last = first + dt.timedelta(days=1)
    elif month:
        last = dt.datetime(year + month // 12, month % 12 + 1, 1, tzinfo=dt.UTC)
    else:
        last = dt.datetime(year + 1, 1, 1, tzinfo=dt.UTC)
    epoch = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)
    return tuple(round((x - epoch).total_seconds() * 1000) for x in (first, last))


def _contains(column: Column, value: str, ignore_case: bool) -> Column:
    return F.lower(column).contains(value.lower()) if ignore_case else column.contains(value)


def _leaf(c: Condition, ignore_case: bool) -> Column:
    if c.kind == "nothing":
        return F.lit(False)
    if c.kind == "name":
        if "*" in c.value:
            pattern = "(?s)^" + ".*".join(re.escape(x.lower() if ignore_case else x) for x in c.value.split("*")) + "$"
            return (F.lower("rel_path") if ignore_case else F.col("rel_path")).rlike(pattern)
        return _contains(F.col("rel_path"), c.value, ignore_case)
    if c.kind in ("mime", "origin"):
        return _contains(F.col(c.kind), c.value, ignore_case)
    if c.kind == "size":
        op, n = _SIZE.match(c.value).groups()
        return {">=": F.col("size") >= int(n), "<=": F.col("size") <= int(n), ">": F.col("size") > int(n), "<": F.col("size") < int(n)}.get(op, F.col("size") == int(n))
    if c.kind == "tag":
        return F.exists("tags", lambda t: _contains(t, c.value, ignore_case))
    if c.kind == "accepted":
        return F.coalesce("accepted", F.lit(False)) == F.lit(c.value.lower() in ("yes", "true", "1"))
    low, high = date_span(c.value)
    best = F.coalesce("taken_ms", "modified_ms")
    return {"date": (best >= low) & (best < high), "after": best >= low, "before": best < low}[c.kind]


def predicate(f: FileFilter) -> Column:
    """One column that is never null: what is absent does not match, and its negation does."""
    out = F.lit(True)
    for c in f.conditions:
        leaf = F.coalesce(_leaf(c, f.ignore_case), F.lit(False))
        out = out & (~leaf if c.negated else leaf)
    return out


def matching(files: DataFrame, expression: str | None, annotations: DataFrame | None = None, accepted: DataFrame | None = None) -> DataFrame:
    """Live files that match; side tables are joined only if the expression names them."""
    f = parse(expression)
    rows, columns = files.where(~F.col("missing")), files.columns
    if f.uses_tags:
        rows = rows.join(annotations, ["repo", "rel_path"], "left")
    if f.uses_accepted:
        rows = rows.join(accepted.withColumn("accepted", F.lit(True)), ["repo", "size", "hash"], "left")
    return rows.where(predicate(f)).select(*columns)
