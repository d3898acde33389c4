"""Cycle CSV: five rows of metadata, an empty one, a header, a row a position. Written and read."""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewheel.functions.names import signature

# The labels of the metadata and the header of the file format.
LABELS = ("# Cycle Statistics", "# Iterations", "# Kernels per cycle", "# Avg cycle time (us)", "# Total time (us)")
HEADER = ("index", "kernel_name", "avg_duration_us", "min_duration_us", "max_duration_us", "stddev_us", "count", "pct_of_cycle")


def cycle_csv_text(header: dict, rows: list[dict]) -> str:
    """The file of one cycle; ``rows`` are its positions in order."""
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(LABELS[:1])
    for label, value in zip(LABELS[1:], (header["reps"], header["cycle_len"], f"{header['avg_cycle_time'] or 0:.3f}", f"{header['total_time'] or 0:.3f}"), strict=True):
        w.writerow([label, value])
    out.write("\n")
    w.writerow(HEADER)
    for r in rows:
        share = r["avg_dur"] / header["avg_cycle_time"] * 100 if header["avg_cycle_time"] else 0.0
        w.writerow([r["index"], r["name"], *[f"{r[c]:.3f}" for c in ("avg_dur", "min_dur", "max_dur", "stddev")], r["cnt"], f"{share:.4f}"])
    return out.getvalue()


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, value): the lines of each file; a file is a few dozen lines and is read whole."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return whole.select("path", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))


def _fields(value: Column) -> Column:
    """The fields of a CSV line; quoted ones may hold commas and doubled quotes."""
    raw = F.regexp_extract_all(F.concat(value, F.lit(",")), F.lit(r'((?:"(?:[^"]|"")*"|[^",]*)),'), F.lit(1))
    return F.transform(raw, lambda x: F.when(x.startswith('"'), F.replace(F.substr(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))


def read_cycles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Kernels (path, pos, name, avg_dur, min_dur, max_dur, stddev, pct) and metadata (path, iterations, avg_cycle_time).

    Columns are found by the header, the first line whose first field is ``index``, or the
    first line of a file without metadata. Lines of too few fields or without an average are
    left out; other values that do not parse are 0.
    """
    lines = _lines(spark, path).where(F.length(F.trim("value")) > 0).withColumn("f", _fields(F.col("value")))
    first = F.min(F.when(F.array_contains("f", "kernel_name"), F.col("line_no"))).over(Window.partitionBy("path"))
    lines = lines.withColumn("head_no", first)
    head = lines.where("line_no = head_no").select("path", F.col("f").alias("h"))
    meta = lines.where("line_no < head_no").groupBy("path").agg(*[F.max(F.when(F.get("f", 0) == label, F.get("f", 1))).try_cast(kind).alias(name) for label, kind, name in ((LABELS[1], "long", "iterations"), (LABELS[3], "double", "avg_cycle_time"))])
    data = lines.where("line_no > head_no").join(F.broadcast(head), "path")

    def column(name: str) -> Column:
        return F.get("f", (F.array_position("h", name) - 1).cast("int"))

    number = {out: F.coalesce(F.when(F.array_position("h", name) > 0, column(name)).try_cast("double"), F.lit(0.0)).alias(out) for name, out in (("min_duration_us", "min_dur"), ("max_duration_us", "max_dur"), ("stddev_us", "stddev"), ("pct_of_cycle", "pct"))}
    rows = data.where(column("avg_duration_us").try_cast("double").isNotNull() & column("kernel_name").isNotNull())
    kernels = rows.select("path", "line_no", column("kernel_name").alias("name"), column("avg_duration_us").try_cast("double").alias("avg_dur"), *number.values())
    pos = (F.row_number().over(Window.partitionBy("path").orderBy("line_no")) - 1).cast("long")
    return kernels.withColumn("pos", pos).drop("line_no"), head.select("path").join(meta, "path", "left").fillna(0)


def signature_shares(kernels: DataFrame, drop_first: bool = True) -> DataFrame:
    """(path, sig, weight): per cent of the cycle by signature. ``drop_first`` leaves out each file's first kernel, as
    the established tool does when it skips the metadata."""
    rows = kernels.where("pos > 0") if drop_first else kernels
    return rows.groupBy("path", signature(F.col("name")).alias("sig")).agg(F.sum("pct").alias("weight"))


def cycle_files(base: str) -> list[str]:
    """``<base>_cycle_1.csv`` and on, up to the first number that is missing."""
    import os

    out: list[str] = []
    while os.path.exists(f"{base}_cycle_{len(out) + 1}.csv"):
        out.append(f"{base}_cycle_{len(out) + 1}.csv")
    return out
