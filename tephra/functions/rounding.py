"""Decimal places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column | str, digits: int) -> Column:
    """c to so many places, as SQL engines do it: the nearest whole number of its scaled value.

    Spark's round takes the shortest decimal text of a double instead, which has some values on the other side of a half."""
    scale = float(10**digits)
    return F.round((F.col(c) if isinstance(c, str) else c) * scale, 0) / scale
