"""A name for a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F, types as T


def let(value: Column, body: Callable[[Column], Column], kind: str | T.DataType | None = None) -> Column:
    """``body`` of a value that is computed once, however often the body uses it.

    ``kind`` is the type of the body. With it the type is told once, when the plan is made; without it Spark asks all that the
    body holds for its type each time that a row is read, which costs most in bodies inside bodies.
    """
    if kind is None:
        return F.get(F.transform(F.array(value), body), F.lit(0))
    return F.aggregate(F.array(value), F.lit(None).cast(kind), lambda _, x: body(x).cast(kind))
