"""Evaluate once, use often: built-in lambdas bind a value, where repeating an expression would evaluate it again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), lambda v: body(v))[0]


def fresh(name: str, columns: list[str]) -> str:
    """name, with as many leading underscores as keep it apart from columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name
