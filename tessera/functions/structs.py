"""Fixed heterogeneous rows: structs with fields _1, _2, …"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def row(*values: Column) -> Column:
    return F.struct(*[v.alias(f"_{i + 1}") for i, v in enumerate(values)])


def _fields(r: Column, arity: int) -> list[Column]:
    return [r[f"_{i + 1}"] for i in range(arity)]


def item(r: Column, place: int) -> Column:
    """The field at a place from 0."""
    return r[f"_{place + 1}"]


def with_item(r: Column, arity: int, place: int, value: Column) -> Column:
    f = _fields(r, arity)
    return row(*f[:place], value, *f[place + 1 :])


def add_item(r: Column, arity: int, place: int, value: Column) -> Column:
    f = _fields(r, arity)
    return row(*f[:place], value, *f[place:])


def remove_item(r: Column, arity: int, place: int) -> Column:
    f = _fields(r, arity)
    return row(*f[:place], *f[place + 1 :])


def to_array(r: Column, arity: int) -> Column:
    return F.array(*_fields(r, arity))
