"""Conversations in order over range partitions, so that one conversation may span many tasks.

Rows are range-partitioned by (conversation, order) and sorted. A kernel walks a partition with a
state that starts anew with each conversation. Its rows are written with the number of their
partition; what a conversation has brought together in earlier partitions is added afterwards.
Only the first conversation of a partition can have begun before it, so there are at most as many
such carries as partitions, which bounds the table that is broadcast.
"""

from __future__ import annotations

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factorlab.llm.common import by_value

by_value(__name__)


def ranged(rows: DataFrame, *order: str) -> DataFrame:
    """Range partitions, each sorted; nulls first. Equal rows stay together."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, *order).sortWithinPartitions(*order)


def partition_number() -> int:
    return TaskContext.get().partitionId()


def carries(walked: DataFrame, key: str, totals: dict) -> DataFrame:
    """(key, _part, carried columns): totals of the partitions before, for keys that span several.

    `totals` maps a column to the aggregate of one partition's rows; each is summed over the parts before.
    """
    per_part = walked.groupBy(key, "_part").agg(*[a.alias(c) for c, a in totals.items()])
    # A key has no more rows here than there are range partitions.
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    summed = per_part.select(F.col(key).alias("_key"), "_part", *[F.sum(c).over(before).alias(c) for c in totals])
    return summed.filter(F.col(next(iter(totals))).isNotNull())


def with_carries(walked: DataFrame, carried: DataFrame, key: str) -> DataFrame:
    """Every row with the carried columns of its key and partition; null where nothing came before."""
    c = F.broadcast(carried.withColumnRenamed("_part", "_carried"))
    return walked.join(c, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_carried")), "left").drop("_key", "_carried")
