"""Size checks ahead of broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows, and bytes of their values, that every executor can hold.
SMALL, BYTES = 200_000, 32 << 20


def _bytes(name: str, kind: str) -> Column:
    """About what a value takes: 16 bytes, more for text and for an array's elements."""
    c = F.col(f"`{name}`")
    if kind in ("string", "binary"):
        more = F.octet_length(c)
    elif kind.startswith("array<string"):
        more = F.aggregate(c, F.lit(0), lambda a, x: a + 16 + F.coalesce(F.octet_length(x), F.lit(0)))
    elif kind.startswith("array"):
        more = 16 * F.size(c) * (1 + kind.count(","))
    else:
        more = F.lit(0)
    return F.coalesce(more, F.lit(0)).cast("long") + 16


def fits(df: DataFrame, rows: int = SMALL, most: int = BYTES) -> bool:
    """No more than so many rows and bytes; reads a little more than that at most."""
    each = sum((_bytes(c, t) for c, t in df.dtypes), F.lit(0))
    n, size = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(each), F.lit(0))).first()
    return n <= rows and size <= most


def small(df: DataFrame, rows: int = SMALL, most: int = BYTES) -> DataFrame:
    """Broadcast if it fits; otherwise left to a shuffled join."""
    return F.broadcast(df) if fits(df, rows, most) else df
