"""The predicate algebra: every leaf is two-valued, so a negation turns a missing value into true."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed fields that predicates may name.
FIELDS = frozenset(
    "record_id kind level severity_number message service environment release logger source_event_id trace_id span_id issue_id exception_type platform server_name sdk_name".split()
)
SLOTS = {"string": "string_value", "integer": "integer_value", "double": "double_value", "boolean": "boolean_value"}
#: Constructs that Java's regular expressions accept and linear-time engines do not.
_LOOKS_AROUND = re.compile(r"\(\?(?:[=!>]|<[=!])|\\[1-9]|\\k<|[*+?}]\+")


def two_valued(p: Column) -> Column:
    return F.coalesce(p, F.lit(False))


def constant(value: bool) -> Column:
    return F.lit(value)


def field(name: str) -> Column:
    if name not in FIELDS:
        raise ValueError(f"no such field: {name}")
    return F.col(name)


def _stored(namespace: str, path: str) -> Column:
    return F.filter("attrs", lambda a: (a["namespace"] == namespace) & (a["path"] == path))


def stored_one(namespace: str, path: str) -> Column:
    """The stored attribute, null if missing; a path stored twice is an error."""
    found = _stored(namespace, path)
    return F.when(F.size(found) > 1, F.raise_error(F.lit(f"attribute {namespace}{path} is stored twice"))).otherwise(F.get(found, F.lit(0)))


def attr(namespace: str, path: str, value_type: str) -> Column:
    """The attribute's value where it is stored with this type, else null."""
    one = stored_one(namespace, path)
    return F.when(one["value_type"] == value_type, one[SLOTS[value_type]])


def eq(a: Column, b) -> Column:
    return two_valued(a == b)


def ne(a: Column, b) -> Column:
    return two_valued(a != b)


def lt(a: Column, b) -> Column:
    return two_valued(a < b)


def le(a: Column, b) -> Column:
    return two_valued(a <= b)


def gt(a: Column, b) -> Column:
    return two_valued(a > b)


def ge(a: Column, b) -> Column:
    return two_valued(a >= b)


def all_of(*parts: Column) -> Column:
    return reduce(lambda a, b: a & b, parts)


def any_of(*parts: Column) -> Column:
    return reduce(lambda a, b: a | b, parts)


def not_(p: Column) -> Column:
    return ~p


def in_(a: Column, values: Sequence) -> Column:
    if not 1 <= len(values) <= 100:
        raise ValueError("between 1 and 100 values")
    return two_valued(a.isin(list(values)))


def contains(a: Column, text: str) -> Column:
    """A literal substring; no character is a wildcard."""
    return two_valued(F.contains(a, F.lit(text)))


def starts_with(a: Column, text: str) -> Column:
    return two_valued(F.startswith(a, F.lit(text)))


def ends_with(a: Column, text: str) -> Column:
    return two_valued(F.endswith(a, F.lit(text)))


def icontains(a: Column, text: str) -> Column:
    return two_valued(F.contains(F.lower(a), F.lower(F.lit(text))))


def matches(a: Column, pattern: str) -> Column:
    """A partial match of a regular expression without look-around and back-references."""
    if len(pattern.encode()) > 1024 or _LOOKS_AROUND.search(pattern):
        raise ValueError("the pattern is too long, looks around or refers back")
    return two_valued(a.rlike(pattern))


def text(value: str) -> Column:
    """Any search value contains the literal."""
    return two_valued(F.exists("search_values", lambda v: F.contains(v, F.lit(value))))


def exists(namespace: str, path: str) -> Column:
    return two_valued(F.size(_stored(namespace, path)) > 0)


def is_null(namespace: str, path: str) -> Column:
    """Present, with an explicit null."""
    return two_valued(stored_one(namespace, path)["value_type"] == "null")


def array_contains(namespace: str, path: str, value_type: str, value) -> Column:
    """A direct child (path/<digits>) with the typed value; deeper ones do not count, a child stored twice is an error."""
    children = F.filter("attrs", lambda a: (a["namespace"] == namespace) & F.startswith(a["path"], F.lit(path + "/")) & F.substring(a["path"], len(path) + 2, 1024).rlike("^[0-9]+$"))
    paths = F.transform(children, lambda a: a["path"])
    checked = F.when(F.size(F.array_distinct(paths)) < F.size(paths), F.raise_error(F.lit(f"a child of {path} is stored twice"))).otherwise(children)
    return two_valued(F.exists(checked, lambda a: (a["value_type"] == value_type) & (a[SLOTS[value_type]] == value)))


@dataclass(frozen=True)
class Scope:
    """What every query is limited to, whatever its own predicate says."""

    tenant: int
    projects: tuple[int, ...]
    kinds: tuple[str, ...]
    start_us: int
    end_us: int
    basis: str = "event"
    floor_us: int | None = None
    cuts: tuple[int, ...] | None = None

    def predicate(self) -> Column:
        """Comparisons with literals on plain columns, so that they reach the Parquet scan."""
        t = F.col(f"{self.basis}_time_us")
        parts = [F.col("tenant_id") == self.tenant, F.col("project_id").isin(*self.projects), F.col("kind").isin(*self.kinds), t >= self.start_us, t < self.end_us]
        if self.floor_us is not None:
            parts.append(F.col("received_time_us") >= self.floor_us)
        if self.cuts is not None:
            parts += [F.col("batch_seq") <= max(self.cuts), F.col("batch_seq") <= F.get(F.array(*map(F.lit, self.cuts)), F.col("lane_id"))]
        return all_of(*parts)

    def apply(self, records: DataFrame) -> DataFrame:
        return records.where(self.predicate())


def lane_cut(records: DataFrame, cuts: DataFrame) -> DataFrame:
    """Rows up to their lane's cut; ``cuts`` has one row per lane (lane_id, cut_seq)."""
    return records.join(F.broadcast(cuts), "lane_id").where("batch_seq <= cut_seq").drop("cut_seq")
