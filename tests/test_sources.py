import gzip
import io
import json
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewheel import cli
from tracewheel.sources import cycle_csv, reports
from tracewheel.sources.json_stream import array_elements
from tracewheel.sources.traces import each_event, kernel_slice, read_traces

KERNEL = {"name": "k1", "cat": "kernel", "ph": "X", "ts": 1.5, "dur": 2.0, "pid": 1, "tid": 2}
ELEMENTS = [
    KERNEL,
    KERNEL | {"pid": "Spans"},
    KERNEL | {"pid": 1.5},
    {"Name": "k2", "cat": "kernel", "ph": "X", "args": {"a": [1, {"b": 2}]}},
    KERNEL | {"cat": "cpu_op"},
    7,
    KERNEL | {"dur": "9"},
]


@pytest.mark.parametrize("suffix", [".json", ".json.gz"])
def test_trace_keeps_kernels_and_skips_odd_elements(spark, tmp_path, suffix):
    path = tmp_path / f"t{suffix}"
    data = json.dumps({"displayTimeUnit": "ms", "traceEvents": ELEMENTS, "other": {"x": 1}}, indent=1).encode()
    path.write_bytes(gzip.compress(data) if suffix.endswith("gz") else data)
    rows = read_traces(spark, str(path)).orderBy("seq").collect()
    assert [(r["seq"], r["name"], r["dur"], r["pid"]) for r in rows] == [(0, "k1", 2.0, 1), (1, "k2", 0.0, 0)]


@pytest.mark.parametrize("text", ["[1, 2]", '{"traceEvents": {"a": 1}}'])
def test_trace_of_another_shape_is_an_error(spark, tmp_path, text):
    (tmp_path / "t.json").write_text(text)
    with pytest.raises(Exception, match="not a|array"):
        read_traces(spark, str(tmp_path / "t.json")).collect()


def odd_document():
    """A document with strings that hold brackets, other arrays, nested objects and characters of several bytes."""
    return {"a": [1, {"traceEvents": [2]}], "s": '"]}{[\\', "traceEvents": [{"x": "]}, ü\\\""}, 12, -1.5e3, None, [[]], "é", {"n": {"m": [{}]}}, 123456], "b": None}


@pytest.mark.parametrize("piece", [1, 2, 7, 1 << 20])
def test_elements_come_whole_however_the_text_is_cut(piece):
    doc = odd_document()
    text = json.dumps(doc, indent=1, ensure_ascii=False).encode()
    assert list(array_elements(io.BytesIO(text), "traceEvents", piece)) == doc["traceEvents"]
    assert list(array_elements(io.BytesIO(b'{"a": 1}'), "traceEvents", piece)) == []
    for bad in (b"", b"[1]", b'{"traceEvents": 3}', b'{"traceEvents": [1, }', b'{"traceEvents": [1'):
        with pytest.raises(ValueError):
            list(array_elements(io.BytesIO(bad), "traceEvents", piece))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.recursive(st.none() | st.booleans() | st.integers() | st.text(), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(), c, max_size=3), max_leaves=6), max_size=5), st.integers(1, 40), st.booleans())
def test_elements_equal_those_of_a_whole_parse(elements, piece, ascii_only):
    text = json.dumps({"k": 1, "traceEvents": elements}, ensure_ascii=ascii_only).encode("utf-8", "replace")
    assert list(array_elements(io.BytesIO(text), "traceEvents", piece)) == json.loads(text)["traceEvents"]


def test_kernel_slices_take_only_fitting_values():
    assert kernel_slice(KERNEL | {"ts": 3, "pid": None})["ts"] == 3.0 and kernel_slice(KERNEL | {"pid": None})["pid"] == 0
    assert kernel_slice(KERNEL | {"NAME": "k9"})["name"] == "k9"
    for odd in ({"pid": True}, {"pid": 1e3}, {"pid": 1 << 63}, {"ts": "1"}, {"name": 5}, {"dur": []}):
        assert kernel_slice(KERNEL | odd) is None


def test_a_folder_of_traces_is_read_in_parallel(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"t{k}.json").write_text(json.dumps({"traceEvents": [KERNEL | {"pid": k, "ts": i} for i in range(k * 5000)]}))
    rows = read_traces(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() == 3
    got = rows.groupBy("pid").agg({"seq": "max", "trace_id": "count", "path": "min"}).collect()
    assert sorted((r["pid"], r["max(seq)"], r["count(trace_id)"]) for r in got) == [(1, 4999, 5000), (2, 9999, 10000)]
    assert rows.where("seq <> ts").count() == 0


def test_callback_stops(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"traceEvents": [KERNEL] * 5}))
    assert each_event(spark, str(tmp_path / "t.json"), lambda e: False) == 1
    # What follows the last event asked for is not read: here it is no JSON.
    (tmp_path / "b.json").write_text('{"traceEvents": [' + json.dumps(KERNEL) + ", " + json.dumps(KERNEL | {"name": "k2"}) + ", oh no")
    seen = []
    assert each_event(spark, str(tmp_path / "b.json"), lambda e: seen.append(e["name"]) or len(seen) < 2) == 2 and seen == ["k1", "k2"]


def rows_of(n):
    return [{"index": k, "name": f'kernel_{k}<int, "q">', "avg_dur": 1.0 + k, "min_dur": 1.0, "max_dur": 9.0, "stddev": 0.5, "cnt": 7, "total_dur": 7.0} for k in range(n)]


HEADER = {"cycle_len": 3, "reps": 7, "avg_cycle_time": 6.0, "total_time": 42.0}


def test_cycle_csv_round_trip(spark, tmp_path):
    path = tmp_path / "a_cycle_1.csv"
    path.write_text(cycle_csv.cycle_csv_text(HEADER, rows_of(3)))
    kernels, meta = cycle_csv.read_cycles(spark, str(path))
    got = kernels.orderBy("pos").collect()
    assert [(r["pos"], r["name"], r["avg_dur"], r["stddev"]) for r in got] == [(k, f'kernel_{k}<int, "q">', 1.0 + k, 0.5) for k in range(3)]
    assert round(got[2]["pct"], 3) == 50.0
    assert [(m["iterations"], m["avg_cycle_time"]) for m in meta.collect()] == [(7, 6.0)]
    shares = {r["sig"]: r["weight"] for r in cycle_csv.signature_shares(kernels).collect()}
    assert sum(shares.values()) == pytest.approx(100 * 5 / 6, abs=1e-3)  # the first kernel is left out
    assert cycle_csv.cycle_files(str(tmp_path / "a")) == [str(path)]


def test_cycle_csv_without_metadata_skips_bad_rows(spark, tmp_path):
    (tmp_path / "b.csv").write_text("kernel_name,avg_duration_us,min_duration_us\nk,1.5,x\nbad,n/a,1\nshort\n")
    kernels, _ = cycle_csv.read_cycles(spark, str(tmp_path / "b.csv"))
    assert [(r["name"], r["avg_dur"], r["min_dur"], r["max_dur"]) for r in kernels.collect()] == [("k", 1.5, 0.0, 0.0)]


def test_reports_of_a_cycle():
    kinds = [{"category": "Other", "kernels": 3, "dur": 6.0}]
    assert reports.cycle_text("x.json", HEADER, rows_of(3), kinds).startswith('{\n  "cycle_length": 3')
    assert reports.cycle_text("x.csv", HEADER, rows_of(3), kinds).splitlines()[6].startswith("index,kernel_name,avg_duration_us")
    text = reports.cycle_text("x.txt", HEADER, rows_of(3), kinds)
    assert " 1. [   2] kernel_2" in text and "(50.00% of cycle)" in text and "Other               :    3 kernels" in text


def trace(n=40):
    """A 12-kernel cycle, twenty times, then a 14-kernel one, thirty times."""
    events = [KERNEL | {"name": f"pre_{k}<a>", "dur": k + 1.0} for _ in range(n) for k in range(12)]
    return events + [KERNEL | {"name": f"dec_{k}<b>", "dur": k + 2.0} for _ in range(n) for k in range(14)]


def test_command_line_end_to_end(spark, tmp_path, capsys):
    (tmp_path / "t.json").write_text(json.dumps({"traceEvents": trace()}))
    base = str(tmp_path / "run")
    assert cli.main(["-input", str(tmp_path / "t.json"), "-output", base, "-mode", "llm"], spark) == 0
    assert "# Iterations,40" in (tmp_path / "run_prefill.csv").read_text()
    assert cli.main(["detect", "-input", str(tmp_path / "t.json"), "-output", base], spark) == 0
    files = cycle_csv.cycle_files(base)
    assert len(files) == 2
    assert cli.main(["compare-csv", "-baseline", files[0], "-new", files[0], "-output", str(tmp_path / "c.csv")], spark) == 0
    lines = (tmp_path / "c.csv").read_text().splitlines()
    assert lines[1].startswith("Total (12 eager kernels),(12 compiled kernels),78.000") and all(x.endswith(",exact") for x in lines[2:])
    assert cli.main(["compare-all", "-baseline", base, "-new", base, "-output", str(tmp_path / "c.xlsx"), "-smart"], spark) == 0
    with zipfile.ZipFile(tmp_path / "c.xlsx") as z:
        assert "xl/worksheets/sheet2.xml" in z.namelist()
        assert "Base1↔New1 (100%)" in z.read("xl/workbook.xml").decode()
        assert '<autoFilter ref="A1:L14"/>' in z.read("xl/worksheets/sheet1.xml").decode()
    assert cli.main(["kmer", "-input", str(tmp_path / "t.json"), "-output", str(tmp_path / "km")], spark) == 0
    # Both cycles start in the first thousand events, which the first to be taken claims.
    assert len(cycle_csv.cycle_files(str(tmp_path / "km"))) == 1
    assert cli.main(["test-kmer", str(tmp_path / "t.json")], spark) == 0
    assert "reps=40" in capsys.readouterr().out


def test_expected_failures_exit_with_one(spark, tmp_path):
    assert cli.main(["-input", str(tmp_path / "none.json")], spark) == 1
    (tmp_path / "e.json").write_text('{"traceEvents": []}')
    assert cli.main(["-input", str(tmp_path / "e.json")], spark) == 1
    (tmp_path / "l.json").write_text("[]")
    assert cli.main(["-input", str(tmp_path / "l.json")], spark) == 1
    for argv in ([], ["-mode", "all"], ["compare-csv", "-baseline", "x"], ["kmer"], ["test-kmer"], ["odd"]):
        with pytest.raises(SystemExit) as stopped:
            cli.main(argv, spark)
        assert stopped.value.code == 1
    assert cli.main(["compare-all", "-baseline", str(tmp_path / "x"), "-new", str(tmp_path / "y"), "-output", str(tmp_path / "z.xlsx")], spark) == 1
