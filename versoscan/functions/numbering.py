"""Numbers by a global order, from range partitions and their sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versoscan.functions.lineage import cut


def numbered(df: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """df with the place (1, 2, ...) of each row in ``order``; which of two rows that tie comes first is left open.

    The rows are dealt over tasks by ranges of the order and sorted there. A task's rows are then numbered from the
    sizes of the tasks before it: no task sees more than its own range. The driver gets one row a task. The sorted
    rows are checkpointed, since the sizes and the numbers must come from the same partitions.
    """
    placed = cut(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    )
    sizes = sorted(placed.groupBy("_part").agg(F.count("*"), F.min("_at")).collect())
    before, shifts = 0, []
    for part, rows, first in sizes:
        shifts.append((part, before + 1 - first))
        before += rows
    shift = df.sparkSession.createDataFrame(shifts, "_part int, _shift long")  # one row a task
    out = placed.join(F.broadcast(shift), "_part").withColumn(name, F.col("_at") + F.col("_shift"))
    return out.drop("_part", "_at", "_shift")
