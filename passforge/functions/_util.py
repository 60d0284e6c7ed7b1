from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with ``value`` computed once however often ``then`` names it."""
    return F.transform(F.array(value), then)[0]


def as_col(x) -> Column:
    """Column as is, a string as a column name, anything else as a literal."""
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)
