"""Order-free digests of table contents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# What separates the values of a row, and what stands for a null among them.
SEPARATOR = "\x1f"
NULL = "\x1e"


def row_digest(*cols: Column) -> Column:
    """60 bits of the MD5 of the given values, as a number that can be summed."""
    text = F.concat_ws(SEPARATOR, *[F.coalesce(c.cast("string"), F.lit(NULL)) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(20,0)")


def table_digest(*cols: Column) -> Column:
    """Sum of the row digests: equal for equal rows in any order, combined before the shuffle."""
    return F.sum(row_digest(*cols)).cast("decimal(38,0)")
