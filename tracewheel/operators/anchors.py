"""Anchors: names that recur at near-constant distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_COUNT = 5
MIN_LENGTH = 10
TRACE = ["trace_id"]


def div(a: Column | str, b: Column | int) -> Column:
    """Integer division of non-negative numbers."""
    a = F.col(a) if isinstance(a, str) else a
    return F.floor(a / b).cast("long")


def kernel_counts(events: DataFrame) -> DataFrame:
    """(trace_id, name, cnt)."""
    return events.groupBy("trace_id", "name").agg(F.count("*").alias("cnt"))


def trace_sizes(events: DataFrame) -> DataFrame:
    return events.groupBy("trace_id").agg(F.count("*").alias("n_events"))


def anchor_candidates(events: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    """(trace_id, name, cnt, n_events) of names with 5 to a fifth of all events."""
    # Counts a trace are sums of counts a name, so events are aggregated once.
    counts = kernel_counts(events).withColumn("n_events", F.sum("cnt").over(Window.partitionBy("trace_id")))
    return counts.where((F.col("cnt") >= least) & (F.col("cnt") <= div("n_events", 5)))


#: Positions of a name are put in order within stretches of so many events.
STRETCH = 1 << 20


def with_previous(events: DataFrame, by: list[str]) -> DataFrame:
    """``events`` with prev: the seq of the one before of the same ``by``, null at the first.

    Two levels: events of one stretch are ordered by a task of their own, to which the last one
    of the stretches before, a row a stretch, is added. So a name that holds most of a trace
    does not meet in one task.
    """
    rows = events.withColumns({"_stretch": div("seq", STRETCH), "_carried": F.lit(False)})
    earlier = Window.partitionBy(*by).orderBy("_stretch")
    ends = rows.groupBy(*by, "_stretch").agg(F.max("seq").alias("_last"))
    carried = ends.select(*by, "_stretch", F.lag("_last").over(earlier).alias("seq"), F.lit(True).alias("_carried")).where("seq is not null")
    inside = Window.partitionBy(*by, "_stretch").orderBy("seq")
    both = rows.unionByName(carried, allowMissingColumns=True)
    return both.withColumn("prev", F.lag("seq").over(inside)).where("not _carried").drop("_stretch", "_carried")


def anchor_gaps(events: DataFrame, names: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(trace_id, name, seq, gap) of the events of ``names``; gap is to the one before, null at the first."""
    by = by or ["trace_id", "name"]
    chosen = events.join(names.select(*by), by).select(*by, "seq")
    return with_previous(chosen, by).select(*by, "seq", (F.col("seq") - F.col("prev")).alias("gap"))


def steady(first: Column, low: Column, high: Column, parts: int) -> Column:
    """All gaps lie within first/parts, at least 1, of the first."""
    slack = F.greatest(F.lit(1).cast("long"), div(first, parts))
    return (low >= first - slack) & (high <= first + slack)


def consistent_anchors(events: DataFrame, least: int = MIN_COUNT, min_length: int = MIN_LENGTH) -> DataFrame:
    """(trace_id, name, cnt, n_events, start, cycle_len): candidates whose gaps are all within a fifth of the first."""
    names = anchor_candidates(events)
    gaps = anchor_gaps(events, names).groupBy("trace_id", "name").agg(F.min("seq").alias("start"), F.min_by("gap", F.when(F.col("gap").isNotNull(), F.col("seq"))).alias("cycle_len"), F.min("gap").alias("low"), F.max("gap").alias("high"))
    found = names.join(gaps, ["trace_id", "name"]).where((F.col("cnt") >= least) & (F.col("cycle_len") >= min_length))
    return found.where(steady(F.col("cycle_len"), F.col("low"), F.col("high"), 5)).select("trace_id", "name", "cnt", "n_events", "start", "cycle_len")
