"""Detectors on small traces made by hand, against plain Python."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tracewheel.functions.names import cut_bytes, truncated
from tracewheel.operators import anchors, cycles, stats

rng = random.Random(4)


def trace(spark, *names, ids=None):
    rows = [(t, k, n, 1.0) for t, seq in zip(ids or range(len(names)), names, strict=True) for k, n in enumerate(seq)]
    return spark.createDataFrame(rows, "trace_id long, seq long, name string, dur double")


def plain_reps(names, start, length, ratio=0.9):
    reps, at = 1, start + length
    while at + length <= len(names) and sum(a == b for a, b in zip(names[start : start + length], names[at : at + length], strict=True)) >= ratio * length:
        reps, at = reps + 1, at + length
    return reps


def plain_simple(names, least=10):
    out, at = [], 0
    while at < len(names) - 2 * least:
        seen, found = {}, None
        for i in range(at, len(names)):
            prev = seen.get(names[i])
            seen[names[i]] = i
            if prev is not None and i - prev >= least and (reps := plain_reps(names, prev, i - prev)) >= 5:
                found = (prev, i - prev, reps)
                break
        if found is None:
            break
        out.append(found)
        at = found[0] + found[1] * found[2]
    return out


def noisy(parts):
    """Stretches of (cycle length, repetitions), some names changed, with warm-up between."""
    out = []
    for k, (length, reps) in enumerate(parts):
        out += [f"w{k}_{j % 7}" for j in range(rng.randrange(3, 30))]
        out += [f"c{k}_{j}" if rng.random() > 0.02 else "odd" for _ in range(reps) for j in range(length)]
    return out


def test_simple_cycles_of_many_traces_equal_a_plain_scan(spark):
    seqs = [noisy([(12, 9), (15, 8)]), noisy([(30, 7)]), [f"n{k % 4}" for k in range(60)], noisy([(11, 20), (11, 6), (14, 7)]), ["a"] * 15, []]
    got = cycles.simple_cycles(trace(spark, *seqs), batch=8).collect()
    for t, names in enumerate(seqs):
        assert sorted((r["start"], r["cycle_len"], r["reps"]) for r in got if r["trace_id"] == t) == plain_simple(names)
    assert sum(len(plain_simple(n)) for n in seqs) >= 5


def test_kmer_names_are_cut_by_bytes(spark):
    """Names that agree in 27 bytes and differ in the 30 that count are different; those that agree in 30 are the same."""
    base = "k" * 27
    one = [f"{base}{a}xx_{j}" for j, a in enumerate("abcdefghijkl")]
    two = [f"{base}{a}xx_{j}" for j, a in enumerate("mnopqrstuvwx")]
    between = [f"between_{j}" for j in range(1000)]  # a cycle claims the thousands that it meets
    found = cycles.kmer_cycles(trace(spark, one * 90 + between + two * 90)).orderBy("start").collect()
    assert [(r["start"], r["cycle_len"], r["reps"]) for r in found] == [(0, 12, 90), (2080, 12, 90)]
    alike = [x[:30] + "_other" * 9 for x in one]
    found = cycles.kmer_cycles(trace(spark, one * 90 + between + alike * 95)).collect()
    assert [(r["cycle_len"], r["reps"]) for r in found] == [(12, 95)] and len(found[0]["anchor"]) == 50


def test_names_are_cut_by_bytes(spark):
    texts = ["short", "x" * 31, "é" * 16, "a" + "é" * 16, "日本語" * 4]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", cut_bytes(F.col("t"), 30).alias("cut"), truncated(F.col("t"), 30).alias("dots")).collect()
    for r in rows:
        raw = r["t"].encode()
        assert r["cut"] == (r["t"] if len(raw) <= 30 else raw[:30].decode(errors="replace"))
        assert r["dots"] == (r["t"] if len(raw) <= 30 else raw[:27].decode(errors="replace") + "...")


def test_previous_places_cross_stretches(spark, monkeypatch):
    monkeypatch.setattr(anchors, "STRETCH", 8)
    names = [rng.choice("ab") if k % 11 else "rare" for k in range(100)]
    got = anchors.with_previous(trace(spark, names), ["trace_id", "name"]).orderBy("seq").collect()
    last, want = {}, []
    for k, n in enumerate(names):
        want.append((k, n, last.get(n)))
        last[n] = k
    assert [(r["seq"], r["name"], r["prev"]) for r in got] == want


def test_first_repeat_and_distinct_kmers(spark):
    e = trace(spark, list("abcdbxyzb"), list("abc"), ids=[5, 9])
    assert [tuple(r) for r in cycles.first_repeats(e).collect()] == [(5, 4)]
    assert sorted(tuple(r) for r in cycles.distinct_kmers(e, 2).collect()) == [(5, 8), (9, 2)]


@pytest.mark.parametrize("contiguous", [True, False])
def test_cycle_stats_broadcast_no_row_a_position(spark, contiguous, tmp_path):
    """Few instances have many positions: those of a long trace do not fit the driver. Against plain Python."""
    size, shape = 500_007, {"long": (0, 5, 1000, 500), "whole": (0, 0, 10, 50_000), "past": (0, 499_990, 10, 4), "short": (1, 3, 11, 1)}
    dur = (F.col("seq") * 7919 % 1013).cast("double")
    events = spark.range(size).select(F.lit(0).cast("long").alias("trace_id"), F.col("id").alias("seq"))
    events = events.union(spark.range(40).select(F.lit(1).cast("long"), "id")).withColumns({"name": F.concat(F.lit("k"), (F.col("seq") % 10).cast("string")), "dur": dur})
    rows = [(t, c, start, length, reps) for c, (t, start, length, reps) in shape.items()]
    spark.createDataFrame(rows, "trace_id long, cycle_id string, start long, cycle_len long, reps long").coalesce(1).write.parquet(f"{tmp_path}/found")
    found = spark.read.parquet(f"{tmp_path}/found")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "64m")  # one page of memory is 32 MB, the million positions take more than 64
    try:
        got = stats.cycle_stats(events, found, None if contiguous else stats.contiguous_instances(found), sample=True).collect()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    got = {(r["cycle_id"], r["index"]): r for r in got}
    want = {}
    for c, (t, start, length, reps) in shape.items():
        for at in range(start, min(start + length * reps, (size, 40)[t])):
            want.setdefault((c, (at - start) % length), []).append(at)
    assert got.keys() == want.keys()
    for key, places in want.items():
        d, r = [at * 7919 % 1013 for at in places], got[key]
        assert (r["name"], r["cnt"], r["min_dur"], r["max_dur"], r["total_dur"]) == (f"k{places[0] % 10}", len(d), min(d), max(d), sum(d))
        assert r["stddev"] == pytest.approx(statistics.stdev(d) if len(d) > 1 else 0.0) and r["avg_dur"] == pytest.approx(statistics.mean(d))
