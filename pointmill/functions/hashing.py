"""Hash order and hash uniforms: the reproducible stand-in for seeded shuffles and random numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(*parts) -> Column:
    """md5 of the parts joined by ``::``; strings are column names, other values literals."""
    cols = [p if isinstance(p, Column) else F.col(p) if isinstance(p, str) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("::", *(c.cast("string") for c in cols)))


def uniform(*parts) -> Column:
    """A number in [0, 1) from the first 32 bits of the hash."""
    return F.conv(F.substring(hash_key(*parts), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
