"""The traces that the registered queries work on, made from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewheel.sources.sequence import as_events, dense_sequence
from tracewheel.storage import fresh_path, staged

ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")

_MADE: dict[tuple[str, str], DataFrame] = {}


def two_phase_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven warm-up events, a 24-kernel cycle of four layers, then a 17-kernel cycle: (trace_id, seq, name, dur).

    Written once a session and folder, as a trace would be after its ingest.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MADE:
        lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*ORDER)
        part = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey < 200").select("p_partkey", "p_name", "p_brand", "p_size")
        n = lines.count()
        split = n * 2 // 5
        rows = dense_sequence(lines, [F.col(c) for c in ORDER]).select("seq", F.col("l_extendedprice").alias("p"))
        seq = F.col("seq")
        rows = rows.withColumn("ph", F.when(seq < 7, "w").when(seq < split, "p").otherwise("d"))
        rows = rows.withColumn("k", F.when(seq < 7, 150 + seq).when(seq < split, (seq - 7) % 24).otherwise(100 + (seq - split) % 17))
        joined = rows.join(F.broadcast(part), F.col("k") == F.col("p_partkey"))  # at most 200 parts
        layer = F.concat(F.lit("layer_"), (F.col("k") % 6).cast("string"), F.lit("op<"), F.col("p_brand"), F.lit(","), F.col("p_partkey").cast("string"), F.lit(">"))
        other = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_op"), F.col("p_partkey").cast("string"), F.lit("x<"), F.col("p_brand"), F.lit(">"))
        dur = F.round((F.col("p_size") + 1) * (1 + (F.col("p") / 1000 - F.floor(F.col("p") / 1000)) * 0.02), 6)
        trace = joined.select("seq", F.when(F.col("ph") == "p", layer).otherwise(other).alias("name"), dur.alias("dur"))
        _MADE[key] = staged(as_events(trace), "trace")
    return _MADE[key]


def event_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a trace: it has no cycle."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return as_events(dense_sequence(e.select("event_id", F.col("event_type").alias("name"), F.col("value").alias("dur")), [F.col("event_id")]))


#: Events a trace file.
FILE_EVENTS = 1000


def trace_files(spark: SparkSession, sf_dir: str) -> str:
    """The trace as gzipped JSON files of FILE_EVENTS events each, whose pid is the file's number; the folder's path.

    Every tenth event is followed by one of another category, every hundredth by a kernel whose
    pid is a text: both are to be left out.
    """
    file, place = F.floor(F.col("seq") / FILE_EVENTS).cast("long"), F.col("seq")
    kernel = F.to_json(F.struct("name", F.lit("kernel").alias("cat"), F.lit("X").alias("ph"), place.cast("double").alias("ts"), "dur", file.alias("pid"), F.lit(7).alias("tid"), F.struct(F.lit("a]}").alias("x")).alias("args")))
    other = F.to_json(F.struct("name", F.lit("cpu_op").alias("cat"), F.lit("X").alias("ph")))
    odd = F.to_json(F.struct("name", F.lit("kernel").alias("cat"), F.lit("X").alias("ph"), F.lit("Spans").alias("pid")))
    texts = F.concat_ws(",\n", kernel, F.when(place % 10 == 0, other), F.when(place % 100 == 0, odd))
    rows = two_phase_trace(spark, sf_dir).groupBy(file.alias("file")).agg(F.sort_array(F.collect_list(F.struct(place.alias("seq"), texts.alias("t")))).alias("e"))
    doc = F.concat(F.lit('{"displayTimeUnit": "ms", "otherData": {"traceEvents": [1]}, "traceEvents": ['), F.array_join(F.transform("e", lambda x: x["t"]), ",\n"), F.lit('], "last": [{}]}'))
    path = fresh_path(spark, "trace-files")
    rows.select(doc.alias("value")).coalesce(1).write.option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)
    return path
