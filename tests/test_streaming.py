import json

from tracewheel.streaming.early_stop import early_stop, read_until_cycle, watch_trace


def events(spark, n, cycle):
    return spark.range(n).selectExpr("id as seq", f"concat('k', id % {cycle}) as name", "1.0D as dur", "0L as trace_id")


def test_early_stop_reads_the_first_step_that_shows_the_cycle(spark):
    n, found = early_stop(events(spark, 4000, 60), step=2000)
    assert n == 2000 and found[2:] == (60, 33)


def test_stream_stops_at_the_cycle(spark, tmp_path):
    source, found = str(tmp_path / "in"), []
    df = events(spark, 3000, 60)
    df.write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    watch_trace(stream, str(tmp_path / "table"), str(tmp_path / "check"), found.append, step=1500).awaitTermination()
    assert found and found[0][2] == 60


def test_a_file_is_read_until_the_cycle_shows(spark, tmp_path):
    def element(k):
        return json.dumps({"name": f"k{k % 60}", "cat": "kernel", "ph": "X", "ts": k, "dur": 1})

    (tmp_path / "t.json").write_text('{"traceEvents": [' + ", ".join(map(element, range(2500))) + ", no more")
    got, cycle = read_until_cycle(spark, str(tmp_path / "t.json"), step=2000)
    assert cycle[2:] == (60, 33) and sorted(r["seq"] for r in got.collect()) == list(range(2000))
    (tmp_path / "s.json").write_text('{"traceEvents": [' + ", ".join(map(element, range(70))) + "]}")
    got, cycle = read_until_cycle(spark, str(tmp_path / "s.json"), step=2000)
    assert cycle is None and got.count() == 70
    (tmp_path / "n.json").write_text("{}")
    assert read_until_cycle(spark, str(tmp_path / "n.json"))[0].count() == 0
