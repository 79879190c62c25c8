"""Row frames that answer only when full, and division that never fails."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

KEY, ORDER = "symbol", "timestamp"


def series(*keys: str, order: str = ORDER) -> WindowSpec:
    """Rows of one series in time order."""
    return Window.partitionBy(*(keys or (KEY,))).orderBy(order)


def trailing(n: int, spec: WindowSpec | None = None, skip: int = 0) -> WindowSpec:
    """The last n rows up to the one `skip` back."""
    return (spec or series()).rowsBetween(-(n - 1) - skip, -skip)


def full(agg: Callable[[Column], Column], x: Column, n: int, frame: WindowSpec) -> Column:
    """An aggregate over a frame, null until it has n values."""
    return F.when(F.count(x).over(frame) == n, agg(x).over(frame))


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null where b is 0: windows without movement have no ratio."""
    return F.try_divide(a, b)
