"""Small helpers for plans that must hold at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.settings import DEFAULTS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fits(df: DataFrame, rows: int = DEFAULTS.broadcast_rows) -> bool:
    """Whether df has at most so many rows; looks at no more than it needs to tell."""
    return df.limit(rows + 1).count() <= rows


def bounded(df: DataFrame, rows: int = DEFAULTS.broadcast_rows) -> DataFrame:
    """df with a broadcast hint if it is checked to have at most so many rows, else as it is."""
    return F.broadcast(df) if fits(df, rows) else df


def constants(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of fixed values, always small enough to broadcast."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def r6(c: Column) -> Column:
    return F.round(c, 6)
