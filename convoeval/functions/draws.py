"""Seeded draws keyed on a row's identifier.

``rand(seed)`` depends on how rows are partitioned. A hash of (seed, key) does not, so
every sample, split and truncation repeats exactly on any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_RANGE = 2**32


def draw(seed: int, key: Column) -> Column:
    """A uniform integer in [0, 2**32) for each key (null for a null key)."""
    digest = F.md5(F.concat(F.lit(str(seed)), F.lit(":"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
