"""Command line: detect, compare-csv, compare-all, kmer, test-kmer."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.errors import PythonException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewheel.operators import compare, cycles, similarity, stats
from tracewheel.shipping import ship
from tracewheel.sources import cycle_csv, reports
from tracewheel.sources.sequence import as_events
from tracewheel.sources.traces import read_traces
from tracewheel.storage import scratch, staged


class Stop(Exception):
    """An expected failure: its message is shown, the exit code is 1."""


def load_trace(spark: SparkSession, path: str) -> DataFrame:
    if not os.path.exists(path):
        raise Stop(f"no such file: {path}")
    events = staged(as_events(read_traces(spark, path)), "trace")
    if not events.limit(1).count():
        raise Stop("the trace has no kernel events")
    return events


def _rows(df: DataFrame, *order: str) -> list[dict]:
    return [r.asDict() for r in df.orderBy(*order).collect()]  # positions of one cycle


def _write(text: str, path: str | None) -> None:
    if path is None:
        sys.stdout.write(text)
        return
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def emit_cycle(s: DataFrame, header: DataFrame, cycle_id: str, path: str | None) -> None:
    own, head = s.where(F.col("cycle_id") == cycle_id), header.where(F.col("cycle_id") == cycle_id).collect()[0].asDict()
    kinds = _rows(stats.category_distribution(own).withColumn("_d", -F.col("dur")), "_d", "category")
    _write(reports.cycle_text(path or ".csv", head, _rows(own, "index"), kinds), path)


def detect(spark: SparkSession, a: argparse.Namespace) -> None:
    events = load_trace(spark, a.input)
    patterns, instances, signed = cycles.cycle_patterns(events)
    patterns = staged(patterns, "patterns")
    order = F.row_number().over(Window.partitionBy("trace_id").orderBy("center", "start", "cycle_len", "signature"))
    found = patterns.withColumn("no", order).orderBy("no").collect()
    if not found:
        raise Stop("no cycle patterns were found")
    s = staged(stats.cycle_stats(signed, patterns, instances.join(patterns.select("cycle_id"), "cycle_id", "left_semi")), "stats")
    header = stats.cycle_header(patterns, s)
    if a.mode == "all":
        chosen = [(f"{a.output}_cycle_{r['no']}.csv" if a.output else None, r["cycle_id"]) for r in (found if a.output else found[:1])]
    else:
        by = {r["phase"]: r["cycle_id"] for r in cycles.classify(patterns).collect()}
        chosen = [(f"{a.output}_{phase}.csv", by[phase]) for phase in ("prefill", "decode")] if a.output else [(None, by["decode"])]
    for path, cycle_id in chosen:
        emit_cycle(s, header, cycle_id, path)
    if a.summary:
        for r in found:
            print(f"{r['no']}: start {r['start']}, {r['cycle_len']} kernels, {r['reps']} repetitions", file=sys.stderr)


def _side(spark: SparkSession, path: str, side: str, pair: int) -> tuple[DataFrame, dict]:
    if not os.path.exists(path):
        raise Stop(f"no such file: {path}")
    kernels, meta = cycle_csv.read_cycles(spark, path)
    info = meta.collect()
    return kernels.drop("path", "pct").withColumns({"pair_id": F.lit(pair).cast("long"), "side": F.lit(side)}), info[0].asDict() if info else {}


def compared(spark: SparkSession, pairs: list[tuple[str, str]], mode: str) -> list[tuple[list[dict], dict]]:
    """Matches and information of each pair of cycle files, all pairs in one job."""
    sides, infos = [], []
    for k, (b, n) in enumerate(pairs):
        (base, bi), (new, ni) = _side(spark, b, "baseline", k), _side(spark, n, "new", k)
        sides += [base, new]
        infos.append({"base_reps": bi.get("iterations"), "new_reps": ni.get("iterations"), "base_cycle_time": bi.get("avg_cycle_time"), "new_cycle_time": ni.get("avg_cycle_time")})
    kernels = sides[0]
    for df in sides[1:]:
        kernels = kernels.unionByName(df)
    rows = _rows(compare.compare(kernels, mode), "pair_id", "ord")
    return [([r for r in rows if r["pair_id"] == k], infos[k]) for k in range(len(pairs))]


def compare_csv(spark: SparkSession, a: argparse.Namespace) -> None:
    [(matches, info)] = compared(spark, [(a.baseline, a.new)], a.mode)
    if a.summary:
        sys.stderr.write(reports.compare_summary_text(matches, (a.baseline, a.new)))
    if a.output and a.output.endswith(".xlsx"):
        reports.write_compare_xlsx(a.output, [("Comparison", matches, info)])
    else:
        _write(reports.compare_csv_text(matches), a.output)


def file_similarity(spark: SparkSession, base: list[str], new: list[str]) -> DataFrame:
    """(l, r, sim) of two lists of cycle files, by their numbers from 0."""
    out = []
    for files, c in ((base, "l"), (new, "r")):
        weights = None
        for k, f in enumerate(files):
            w = cycle_csv.signature_shares(cycle_csv.read_cycles(spark, f)[0]).select(F.lit(k).cast("long").alias(c), "sig", "weight")
            weights = w if weights is None else weights.unionByName(w)
        out.append(weights)
    return similarity.weighted_jaccard(*out)


def compare_all(spark: SparkSession, a: argparse.Namespace) -> None:
    base, new = cycle_csv.cycle_files(a.baseline), cycle_csv.cycle_files(a.new)
    if not base or not new:
        raise Stop("no cycle files were found")
    if a.smart:
        pairs = [(int(i), int(j), s) for i, j, s in similarity.smart_pairs(file_similarity(spark, base, new))]
        names = [f"Base{i + 1}↔New{j + 1} ({s * 100:.0f}%)" for i, j, s in pairs]
    else:
        pairs = [(k, k, 1.0) for k in range(min(len(base), len(new)))]
        names = [f"Cycle {k + 1}" for k, _, _ in pairs]
    if not pairs:
        raise Stop("nothing to compare")
    done = compared(spark, [(base[i], new[j]) for i, j, _ in pairs], "align")
    reports.write_compare_xlsx(a.output, [(n, m, info) for n, (m, info) in zip(names, done, strict=True)])


def kmer(spark: SparkSession, a: argparse.Namespace) -> None:
    events = load_trace(spark, a.input)
    found = cycles.kmer_cycles(events).withColumn("cycle_id", F.concat_ws(":", "trace_id", "start", "cycle_len"))
    found = staged(found, "kmer-cycles")
    rows = found.orderBy("trace_id", F.col("start") + F.floor(F.col("cycle_len") * F.col("reps") / 2)).collect()
    if not rows:
        raise Stop("no cycles were found")
    s = staged(stats.cycle_stats(events, found, sample=True), "stats")
    header = stats.cycle_header(found, s, sample=True)
    base = a.output or os.path.splitext(a.input)[0]
    for k, r in enumerate(rows, 1):
        emit_cycle(s, header, r["cycle_id"], f"{base}_cycle_{k}.csv")


def test_kmer(spark: SparkSession, a: argparse.Namespace) -> None:
    events = load_trace(spark, a.input)
    for k, r in enumerate(cycles.kmer_cycles(events).orderBy("trace_id", "start").collect(), 1):
        names = [x["name"] for x in events.where((F.col("trace_id") == r["trace_id"]) & F.col("seq").between(r["start"], r["start"] + min(5, r["cycle_len"]) - 1)).orderBy("seq").collect()]
        print(f"Cycle {k}: start={r['start']}, length={r['cycle_len']}, reps={r['reps']}, center={r['start'] + r['cycle_len'] * r['reps'] // 2}")
        for n in names:
            print(f"  {reports.short(n, 80)}")


class Parser(argparse.ArgumentParser):
    """Missing or unknown arguments exit with 1, as any expected failure."""

    def error(self, message: str):
        self.print_usage(sys.stderr)
        self.exit(1, f"Error: {message}\n")


def parser() -> argparse.ArgumentParser:
    p = Parser(prog="tracewheel")
    sub = p.add_subparsers(dest="command", required=True)
    yes = {"type": lambda v: v.lower() not in ("false", "0", "no"), "nargs": "?", "const": True, "default": True}

    shared = {"help": "folder that the driver and all executors share, for intermediate tables; needed on a cluster"}

    def command(name: str, run, *flags: tuple[str, dict]) -> None:
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        for flag, how in (*flags, ("shared", shared)):
            c.add_argument(*((f"-{flag}", f"--{flag}") if flag[0] != "=" else (flag[1:],)), **how)

    need = {"required": True}
    command("detect", detect, ("input", need), ("output", {}), ("summary", yes), ("mode", {"default": "all"}))
    command("compare-csv", compare_csv, ("baseline", need), ("new", need), ("output", {}), ("summary", yes), ("mode", {"default": "align"}))
    command("compare-all", compare_all, ("baseline", need), ("new", need), ("output", need), ("smart", {"action": "store_true"}))
    command("kmer", kmer, ("input", need), ("output", {}))
    command("test-kmer", test_kmer, ("=input", {}))
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if argv and argv[0].startswith("-") and argv[0] not in ("-h", "--help"):
        argv.insert(0, "detect")
    a = parser().parse_args(argv)
    if spark is None:
        build = SparkSession.builder.appName("tracewheel").config("spark.sql.session.timeZone", "UTC")
        spark = (build.config("spark.checkpoint.dir", a.shared) if a.shared else build).getOrCreate()
    ship(spark)
    try:
        with scratch(spark):
            a.run(spark, a)
    except (Stop, ValueError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    except PythonException as e:  # a trace that does not parse
        print(f"Error: {next((x for x in reversed(str(e).splitlines()) if 'Error' in x), e)}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
