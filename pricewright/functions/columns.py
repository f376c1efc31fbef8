"""Small helpers over Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strings(values) -> Column:
    """An array literal, typed even if empty."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def mapping(pairs: dict) -> Column:
    """A string map literal."""
    flat = [F.lit(x) for kv in pairs.items() for x in kv]
    return F.create_map(*flat) if flat else F.create_map().cast("map<string,string>")


def lookup(table: Column, key: Column) -> Column:
    return F.try_element_at(table, key)


def is_in(value: Column, values) -> Column:
    """Membership that is false, not null, for a null value."""
    return F.coalesce(value.isin(*values), F.lit(False)) if values else F.lit(False)


def first_where(cases: list[tuple[Column, Column]]) -> Column:
    """The value of the first case whose condition holds, else null."""
    out = F.when(*cases[0])
    for condition, value in cases[1:]:
        out = out.when(condition, value)
    return out
