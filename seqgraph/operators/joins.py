"""How tables of unknown size are joined."""

from __future__ import annotations

from pyspark.sql import DataFrame


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join that isn't a broadcast.

    Spark takes a plan's size from its files, as if explodes made no rows: a small file's k-mers would be sent to the driver.
    """
    return df.hint("merge")
