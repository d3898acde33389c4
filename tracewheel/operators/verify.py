"""Verification: how much of each repetition equals the first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewheel.operators.anchors import div
from tracewheel.storage import SMALL_ROWS, small_join, staged

#: Template positions of all cycles that are broadcast at most, eight bytes each.
TEMPLATE_ROWS = 10 * SMALL_ROWS


def repetition_matches(events: DataFrame, cycles: DataFrame, column: str = "name", first_reps: int | None = None) -> DataFrame:
    """(trace_id, cycle_id, rep, matched, cycle_len) of every complete repetition, or of the first ones; rep 0 is the template.

    ``cycles``: (trace_id, cycle_id, start, cycle_len). Names are compared by 64 bits of hash, as
    the established tool does. A cycle carries its template, the hashes of its first repetition,
    in an array; cycles are broadcast behind a check of their number and of all positions. So
    every event is held against the cycles of its trace where it lies, in generated code, and
    only counts a repetition are shuffled. Beyond those bounds cycles are salted copies
    (``small_join``) and templates are joined by offset. Cycles of one place and length are
    verified once.
    """
    key = ["trace_id", "start", "cycle_len"]
    named = cycles.select("cycle_id", *key)
    spans = staged(named.select(*key).distinct(), "spans")
    codes = events.select("trace_id", "seq", F.xxhash64(column).alias("code"))
    places = spans.select(*key, F.posexplode(F.sequence(F.col("start"), F.col("start") + F.col("cycle_len") - 1)).alias("off", "seq"))
    template = places.join(codes, ["trace_id", "seq"]).select(*key, F.col("off").cast("long").alias("off"), F.col("code").alias("first"))
    size = spans.agg(F.coalesce(F.sum("cycle_len"), F.lit(0))).collect()[0][0]
    at = F.col("seq") - F.col("start")
    inside = at >= 0 if first_reps is None else (at >= 0) & (at < first_reps * F.col("cycle_len"))
    where = {"rep": div(at, F.col("cycle_len")), "off": F.pmod(at, F.col("cycle_len"))}
    if size <= TEMPLATE_ROWS:
        arrays = template.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("off", "first"))), lambda x: x["first"]).alias("firsts"))
        rows = small_join(codes, staged(arrays, "templates"), ["trace_id"], inside).withColumns(where)
        rows = rows.withColumn("first", F.get("firsts", F.col("off").cast("int")))
    else:
        rows = small_join(codes, spans, ["trace_id"], inside).withColumns(where).join(template, [*key, "off"])
    same = rows.groupBy(*key, "rep").agg(F.count("*").alias("present"), F.sum((F.col("code") == F.col("first")).cast("long")).alias("matched"))
    return small_join(same.where("present = cycle_len").drop("present"), named, key).select("trace_id", "cycle_id", "rep", "matched", "cycle_len")


def loose_repetitions(matches: DataFrame, expected: DataFrame, ratio: float = 0.95) -> DataFrame:
    """(trace_id, cycle_id, rep): repetitions that match, those between them skipped; rep below ``expected``'s number."""
    return matches.join(expected.select("cycle_id", "expected"), "cycle_id").where((F.col("rep") < F.col("expected")) & (F.col("matched") >= ratio * F.col("cycle_len"))).select("trace_id", "cycle_id", "rep")


def consecutive_repetitions(matches: DataFrame, ratio: float = 0.90) -> DataFrame:
    """(trace_id, cycle_id, reps): repetitions up to the first that does not match."""
    failed = F.min(F.when(F.col("matched") < ratio * F.col("cycle_len"), F.col("rep")))
    return matches.groupBy("trace_id", "cycle_id").agg(F.coalesce(failed, F.max("rep") + 1).alias("reps"))
