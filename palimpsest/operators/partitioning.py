"""Partitionings of data by its values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grid_cell(value: Column, least: float, most: float, cells: int) -> Column:
    """Cell of ``cells`` equal ones between ``least`` and ``most``; what lies outside is in the first or last."""
    cell = F.floor((value - least) * (cells / (most - least))).cast("long")
    return F.greatest(F.lit(0).cast("long"), F.least(F.lit(cells - 1).cast("long"), cell))


def grid_partitions(rows: DataFrame, axes: dict[str, tuple[float, float, int]]) -> DataFrame:
    """``rows`` with ``partition_id``, the cell of a uniform grid in row-major order; axes(column) -> (least, most, cells).
    Rows with a null in an axis are in no cell (null)."""
    ids = [(grid_cell(F.col(c), *axis), axis[2]) for c, axis in axes.items()]
    return rows.withColumn("partition_id", reduce(lambda acc, x: acc * x[1] + x[0], ids, F.lit(0).cast("long")))


def grid_neighbors(ids: DataFrame, shape: list[int]) -> DataFrame:
    """partition_id, neighbor: the cells that touch each of ids(partition_id), diagonals included."""
    found = ids.select("partition_id", F.col("partition_id").alias("rest"))
    axes = []
    for k, n in reversed(list(enumerate(shape))):
        found = found.withColumn(f"x{k}", F.col("rest") % n).withColumn("rest", F.floor(F.col("rest") / n))
        axes.insert(0, (f"x{k}", n))
    for c, n in axes:
        found = found.withColumn(f"{c}_", F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1))).where((F.col(f"{c}_") >= 0) & (F.col(f"{c}_") < n))
    neighbor = reduce(lambda acc, x: acc * x[1] + F.col(f"{x[0]}_"), axes, F.lit(0).cast("long"))
    return found.select("partition_id", neighbor.cast("long").alias("neighbor")).where("partition_id <> neighbor")
