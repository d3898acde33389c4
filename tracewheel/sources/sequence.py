"""Event sequences: (trace_id, seq, name, dur), seq dense from 0 within a trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewheel.storage import staged


def dense_sequence(df: DataFrame, order: list[Column], name: str = "seq") -> DataFrame:
    """Adds a dense 0-based row number in the total order ``order``, without gathering rows in one task.

    Rows are range-partitioned and sorted, then written; a partition's rows are numbered by
    their place in it, and the counts of the partitions before, one row each, are added.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = staged(ordered.withColumn("_id", F.monotonically_increasing_id()), "ordered")
    part, place = F.shiftrightunsigned("_id", 33).alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_place")
    rows = placed.select("*", part, place).drop("_id")
    counts = rows.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    return rows.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_place")).drop("_part", "_place", "_start")


def as_events(df: DataFrame) -> DataFrame:
    """The event columns, with one trace_id where there is none."""
    trace = F.col("trace_id").cast("long") if "trace_id" in df.columns else F.lit(0).cast("long")
    return df.select(trace.alias("trace_id"), F.col("seq").cast("long").alias("seq"), F.coalesce(F.col("name"), F.lit("")).alias("name"), F.coalesce(F.col("dur").cast("double"), F.lit(0.0)).alias("dur"))
