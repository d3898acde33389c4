"""Duration statistics of cycles by position, and summaries over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewheel.functions.names import category
from tracewheel.operators.anchors import div
from tracewheel.storage import small_join


#: A cycle of contiguous repetitions meets events in blocks of so many.
BLOCK = 1 << 12


def contiguous_rows(events: DataFrame, cycles: DataFrame) -> DataFrame:
    """(cycle_id, inst, index, name, dur) of the events in cycles whose repetitions follow one another.

    ``cycles``: (trace_id, cycle_id, start, cycle_len, reps). Each event finds its place by division,
    where it lies; what is joined is a row a block of a cycle, not one a position.
    """
    end = F.col("start") + F.col("reps") * F.col("cycle_len")
    spans = cycles.select("trace_id", "cycle_id", "start", "cycle_len", end.alias("_end")).where("_end > start")
    spans = spans.withColumn("_block", F.explode(F.sequence(div("start", BLOCK), div(F.col("_end") - 1, BLOCK))))
    blocks = events.select("trace_id", "seq", "name", "dur", div("seq", BLOCK).alias("_block"))
    rows = small_join(blocks, spans, ["trace_id", "_block"], (F.col("seq") >= F.col("start")) & (F.col("seq") < F.col("_end")))
    index = F.pmod(F.col("seq") - F.col("start"), F.col("cycle_len"))
    return rows.select("cycle_id", (F.col("seq") - index).alias("inst"), index.alias("index"), "name", "dur")


def instance_rows(events: DataFrame, cycles: DataFrame, instances: DataFrame) -> DataFrame:
    """(cycle_id, inst, index, name, dur) of the events in ``instances`` (trace_id, cycle_id, inst)."""
    lengths = cycles.select("cycle_id", "cycle_len")
    places = instances.join(lengths, "cycle_id").select("trace_id", "cycle_id", "inst", F.posexplode(F.sequence(F.col("inst"), F.col("inst") + F.col("cycle_len") - 1)).alias("index", "seq"))
    # Places are as many as events, but Spark takes them for no more than instances and would broadcast them.
    rows = places.join(events.select("trace_id", "seq", "name", "dur").hint("merge"), ["trace_id", "seq"])
    return rows.select("cycle_id", "inst", F.col("index").cast("long").alias("index"), "name", "dur")


def cycle_stats(events: DataFrame, cycles: DataFrame, instances: DataFrame | None = None, sample: bool = False) -> DataFrame:
    """(cycle_id, index, name, avg_dur, min_dur, max_dur, stddev, cnt, total_dur) of every position of every cycle.

    ``instances``: (trace_id, cycle_id, inst); without them the repetitions of a cycle follow one
    another. Positions past the trace's end are left out. The name is that of the first instance.
    stddev is that of the population, or of the sample, 0 for one value.
    """
    rows = contiguous_rows(events, cycles) if instances is None else instance_rows(events, cycles, instances)
    spread = F.coalesce(F.stddev_samp("dur"), F.lit(0.0)) if sample else F.stddev_pop("dur")
    return rows.groupBy("cycle_id", "index").agg(F.min_by("name", "inst").alias("name"), F.avg("dur").alias("avg_dur"), F.min("dur").alias("min_dur"), F.max("dur").alias("max_dur"), spread.alias("stddev"), F.count("*").alias("cnt"), F.sum("dur").alias("total_dur"))


def contiguous_instances(cycles: DataFrame) -> DataFrame:
    """The instances of cycles whose repetitions follow one another (trace_id, cycle_id, start, cycle_len, reps)."""
    return cycles.select("trace_id", "cycle_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("reps") - 1)).alias("r"), "start", "cycle_len").select("trace_id", "cycle_id", (F.col("start") + F.col("r") * F.col("cycle_len")).alias("inst"))


def cycle_header(cycles: DataFrame, stats: DataFrame, sample: bool = False) -> DataFrame:
    """(cycle_id, cycle_len, reps, avg_cycle_time, total_time): over the durations, or over the averages for ``sample``."""
    sums = stats.groupBy("cycle_id").agg(F.sum("total_dur").alias("total"), F.sum("avg_dur").alias("avg"))
    out = cycles.select("cycle_id", "cycle_len", "reps").join(sums, "cycle_id")
    if sample:
        return out.select("cycle_id", "cycle_len", "reps", F.col("avg").alias("avg_cycle_time"), (F.col("avg") * F.col("reps")).alias("total_time"))
    return out.select("cycle_id", "cycle_len", "reps", F.try_divide(F.col("total"), F.col("reps")).alias("avg_cycle_time"), F.col("total").alias("total_time"))


def with_share(stats: DataFrame, header: DataFrame) -> DataFrame:
    """Adds pct_of_cycle; null where the cycle takes no time."""
    return stats.join(header.select("cycle_id", "avg_cycle_time"), "cycle_id").withColumn("pct_of_cycle", F.when(F.col("avg_cycle_time") != 0, F.col("avg_dur") / F.col("avg_cycle_time") * 100)).drop("avg_cycle_time")


def top_kernels(stats: DataFrame, by: str = "avg_dur", n: int = 10) -> DataFrame:
    """The ``n`` positions of each cycle of the largest ``by``, the first among equals."""
    order = Window.partitionBy("cycle_id").orderBy(F.desc(by), "index")
    return stats.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def category_distribution(stats: DataFrame) -> DataFrame:
    """(cycle_id, category, kernels, dur, pct): positions and time by category."""
    kinds = stats.groupBy("cycle_id", category(F.col("name")).alias("category")).agg(F.count("*").alias("kernels"), F.sum("avg_dur").alias("dur"))
    total = F.sum("dur").over(Window.partitionBy("cycle_id"))
    return kinds.withColumn("pct", F.when(total > 0, F.col("dur") / total * 100))


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    def cut(c: str) -> Column:
        return F.round(F.col(c).cast("double"), digits[c]).alias(c) if c in digits else F.col(c)

    return df.select(*map(cut, df.columns))
