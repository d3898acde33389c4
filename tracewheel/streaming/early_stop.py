"""A trace that grows: events are appended to a table, and the probe runs as the trace passes each step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tracewheel.operators.cycles import quick_probe
from tracewheel.sources.sequence import as_events
from tracewheel.sources.traces import FIELDS, each_event
from tracewheel.storage import fresh_path

STEP = 10_000
ENOUGH = 10


def probe_prefix(events: DataFrame, n: int, min_cycle: int = 50, max_cycle: int = 5000) -> tuple | None:
    """The cycle (name, start, cycle_len, reps) that the first ``n`` events show, if they are many enough."""
    if n < max(5 * min_cycle, 1000):
        return None
    found = quick_probe(events.where(f"seq < {n}"), min_cycle, min(max_cycle, n // 3)).collect()
    return (found[0]["name"], found[0]["start"], found[0]["cycle_len"], found[0]["reps"]) if found else None


def early_stop(events: DataFrame, min_cycle: int = 50, max_cycle: int = 5000, step: int = STEP) -> tuple[int, tuple | None]:
    """(events read, cycle) of one trace: the first prefix of a multiple of ``step`` that shows ten repetitions, else all."""
    n = events.count()
    for size in range(step, n + 1, step):
        found = probe_prefix(events, size, min_cycle, max_cycle)
        if found and found[3] >= ENOUGH:
            return size, found
    return n, None


def read_until_cycle(spark: SparkSession, path: str, min_cycle: int = 50, max_cycle: int = 5000, step: int = STEP) -> tuple[DataFrame, tuple | None]:
    """(events, cycle) of one trace file, read no further than the first multiple of ``step`` that shows ten repetitions.

    The driver holds ``step`` events at most; they are written to a table, which is probed.
    """
    table, rows, cycle = fresh_path(spark, "early"), [], None
    kind = "seq long, " + ", ".join(f"{n} {t}" for n, t in FIELDS.items())

    def write() -> None:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(table)
        rows.clear()

    def visit(event: dict) -> bool:
        nonlocal cycle
        n = visit.seen + 1
        rows.append((visit.seen, *(event[f] for f in FIELDS)))
        visit.seen = n
        if n % step == 0:
            write()
            found = probe_prefix(as_events(spark.read.schema(kind).parquet(table)), n, min_cycle, max_cycle)
            cycle = found if found and found[3] >= ENOUGH else None
        return cycle is None

    visit.seen = 0
    each_event(spark, path, visit)
    if rows or not visit.seen:
        write()
    return as_events(spark.read.schema(kind).parquet(table)), cycle


def watch_trace(stream: DataFrame, table: str, checkpoint: str, on_cycle: Callable[[tuple], None], min_cycle: int = 50, max_cycle: int = 5000, step: int = STEP) -> StreamingQuery:
    """Appends a stream of events (seq, name, dur) to the Parquet folder ``table`` and probes what is there.

    A batch overwrites only its own partition, so a batch that runs twice counts once. When the
    trace passes a multiple of ``step`` events its prefix of that size is probed; at ten
    repetitions ``on_cycle`` is called and the query stops.
    """
    state = {"probed": 0, "found": None}

    def batch(df: DataFrame, number: int) -> None:
        if state["found"]:
            return
        spark = df.sparkSession
        as_events(df).write.mode("overwrite").parquet(f"{table}/batch={number}")
        events = spark.read.option("basePath", table).parquet(table).drop("batch")
        whole = events.count() // step * step
        for size in range(state["probed"] + step, whole + 1, step):
            found = probe_prefix(events, size, min_cycle, max_cycle)
            state["probed"] = size
            if found and found[3] >= ENOUGH:
                state["found"] = found
                on_cycle(found)
                return

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
