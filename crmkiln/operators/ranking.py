"""Positions in a total order without bringing all rows into one task.

Rows are range-partitioned by the order and sorted inside their partitions; each is written with its partition and
its place in it. A position is that place plus the rows of all partitions before. Those counts, one row per
partition, are the only thing that a single task orders, and the only thing that is sent to all tasks.

The placed rows are a written table under ``spark.checkpoint.dir``, because the bounds of the ranges are sampled: both
reads then see the same partitions, also after executors are lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crmkiln.functions.measures import named
from crmkiln.sources.tables import work_directory

_PART, _PLACE, _BEFORE = "__part", "__place", "__before"
#: monotonically_increasing_id has the partition above these bits and the place in it below.
_PLACE_MASK = (1 << 33) - 1


def with_position(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with the position of each row, from 1. ``order`` is a list of ascending expressions that no two
    rows share; an empty frame stays empty."""
    spark = df.sparkSession
    keys = [F.expr(expression) for expression in order]
    path = work_directory(spark, "ranks")
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).selectExpr(
        "*",
        f"spark_partition_id() AS {_PART}",
        f"monotonically_increasing_id() & {_PLACE_MASK}L AS {_PLACE}",
    ).write.parquet(path)
    placed = spark.read.parquet(path)
    before = placed.groupBy(_PART).agg(F.count(F.lit(1)).alias("rows")).selectExpr(
        _PART,
        f"sum(rows) OVER (ORDER BY {_PART} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - rows AS {_BEFORE}",
    )
    # One row per partition, whatever the size of the table.
    return placed.join(F.broadcast(before), _PART).selectExpr(
        *[f"`{column}`" for column in df.columns],
        *named({name: f"{_BEFORE} + {_PLACE} + 1"}),
    )
