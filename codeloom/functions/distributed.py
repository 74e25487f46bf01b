"""Numbering and running totals in a total order, spread over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.session import materialise, small


def _ranged(df: DataFrame, order: list[Column], parts: int | None) -> DataFrame:
    """Rows in ranges of the order, as a table: ``__part`` grows with the order and is fixed once written."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "ranged")


def running(df: DataFrame, order: list[str], partition: list[str] | None = None, total: str | None = None, number: str | None = None, total_name: str = "cumulative", parts: int | None = None) -> DataFrame:
    """Adds a running number and/or the running total of ``total`` per ``partition`` in ``order`` (nulls first).

    Equal to window functions over the partition, but no task sees more than one range of
    the order, however many rows a partition holds: local numbers and sums per range, plus
    what the partition's earlier ranges hold (one row per range and partition). ``order``
    should be unique within a partition; tied rows may be numbered either way.
    """
    keys = list(partition or [])
    rows = _ranged(df, [F.col(c).asc_nulls_first() for c in [*keys, *order]], parts)
    local = Window.partitionBy("__part", *keys).orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    value = F.col(total) if total else F.lit(0)
    rows = rows.withColumn("__n", F.row_number().over(local)).withColumn("__s", F.sum(value).over(local))
    blocks = rows.groupBy("__part", *keys).agg(F.count("*").alias("__k"), F.sum(value).alias("__t"))
    earlier = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("__part", *keys, F.coalesce(F.sum("__k").over(earlier), F.lit(0)).alias("__kb"), F.coalesce(F.sum("__t").over(earlier), F.lit(0)).alias("__tb"))
    renamed = before.select(F.col("__part").alias("__p"), *[F.col(k).alias(f"__k_{k}") for k in keys], "__kb", "__tb")
    on = F.col("__part") == F.col("__p")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    out = rows.join(small(renamed), on)
    columns = [F.col(c) for c in df.columns]
    if number:
        columns.append((F.col("__n") + F.col("__kb")).cast("int").alias(number))
    if total:
        columns.append((F.col("__s") + F.col("__tb")).alias(total_name))
    return out.select(*columns)
