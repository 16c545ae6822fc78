"""Sketches of fixed size: which keys may be in a set, so that rows whose keys are surely outside need no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of a sketch; its broadcast has at most as many numbers.
CELLS = 1 << 20


def _cell(keys: list[str | Column]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(CELLS))


def cells(keys: DataFrame) -> DataFrame:
    """The cells that the rows fall into."""
    return keys.select(_cell(keys.columns).alias("_cell")).distinct()


def repeated(rows: DataFrame, *keys: str, over: int = 1) -> DataFrame:
    """The cells of keys that more than ``over`` rows have; a hash stands for a key, so a cell may be named without need."""
    return rows.select(F.xxhash64(*keys).alias("_hash")).groupBy("_hash").agg(F.count("*").alias("_n")).where(F.col("_n") > over).select(F.pmod("_hash", F.lit(CELLS)).alias("_cell")).distinct()


def maybe(rows: DataFrame, sketch: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key may be in the sketched set."""
    return rows.join(F.broadcast(sketch), _cell(list(keys)) == F.col("_cell"), "left_semi")


def never(rows: DataFrame, sketch: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key isn't in the sketched set."""
    return rows.join(F.broadcast(sketch), _cell(list(keys)) == F.col("_cell"), "left_anti")
