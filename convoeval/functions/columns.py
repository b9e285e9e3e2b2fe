"""Adding columns that cost much to compute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add ``name``, computed once per row even if the result is filtered on it.

    The optimizer moves a filter below the projection that makes its column and computes the
    column once for each mention in the filter, and again after it. It does not move a
    filter below a generator, so the value is generated from an array of one element.
    """
    rest = [c for c in df.columns if c != name]
    return df.select(*(F.col(f"`{c}`") for c in rest), F.explode(F.array(value)).alias(name))
