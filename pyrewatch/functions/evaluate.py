"""Control over how often an expensive expression runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def once(df: DataFrame, name: str, expression: Column) -> DataFrame:
    """Add a column that is computed a single time per row.

    An ordinary derived column is copied into every filter and projection that names it. A generated one stays
    where it is, which matters for JSON parsing and long pattern chains.
    """
    kept = [F.col(c) for c in df.columns if c != name]
    return df.select(*kept, F.explode(F.array(expression)).alias(name))
