"""Comparison of two cycles: alignment with rotation, or greedy matching by signature."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewheel.functions.names import change_class, change_percent, signature
from tracewheel.operators.cycles import standard_instances
from tracewheel.operators.stats import cycle_stats

STATS = ("avg", "min", "max", "stddev")
MATCH_SCHEMA = "pair_id long, ord long, baseline string, new string, match_type string, sig string, base_pos long, new_pos long"


def lcs_table(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of longest common subsequences of all prefixes, a row at a time.

    A row is a running maximum: cell j is the best of the row above up to j and of one more
    than its left neighbour above wherever the symbols agree.
    """
    table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i, x in enumerate(a, 1):
        above = table[i - 1]
        table[i, 1:] = np.maximum.accumulate(np.maximum(above[1:], np.where(b == x, above[:-1] + 1, 0)))
    return table


def best_rotation(base: np.ndarray, new: np.ndarray) -> tuple[int, int]:
    """The first rotation of ``base`` of the longest common subsequence with ``new``, and that length."""
    best = (0, -1)
    for r in range(max(1, len(base))):
        length = int(lcs_table(np.roll(base, -r), new)[-1, -1]) if len(base) and len(new) else 0
        if length > best[1]:
            best = (r, length)
    return best


def _rotation(rows: pd.DataFrame) -> pd.DataFrame:
    base, new = _sides(rows)
    codes = {s: k for k, s in enumerate(pd.unique(pd.concat([base["sig"], new["sig"]])))}
    turn, length = best_rotation(base["sig"].map(codes).to_numpy(int), new["sig"].map(codes).to_numpy(int))
    return pd.DataFrame({"pair_id": [rows["pair_id"].iloc[0]], "rotation": [turn], "lcs": [length]})


def lcs_rotation(kernels: DataFrame) -> DataFrame:
    """(pair_id, rotation, lcs): the rotation of the baseline that shares the longest subsequence of signatures."""
    return kernels.groupBy("pair_id").applyInPandas(_rotation, "pair_id long, rotation long, lcs long")


def _sides(rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    return tuple(rows[rows["side"] == s].sort_values("pos").reset_index(drop=True) for s in ("baseline", "new"))


def _align(rows: pd.DataFrame) -> pd.DataFrame:
    base, new = _sides(rows)
    codes = {s: k for k, s in enumerate(pd.unique(pd.concat([base["sig"], new["sig"]])))}
    a, b = base["sig"].map(codes).to_numpy(int), new["sig"].map(codes).to_numpy(int)
    turn, _ = best_rotation(a, b)
    order = np.roll(np.arange(len(base)), -turn)
    table, out, i, j = lcs_table(a[order], b), [], len(a), len(b)
    while i or j:
        x = order[i - 1] if i else None
        if i and j and a[x] == b[j - 1]:
            kind = "exact" if base["name"][x] == new["name"][j - 1] else "similar"
            out.append((base["name"][x], new["name"][j - 1], kind, new["sig"][j - 1], base["pos"][x], new["pos"][j - 1]))
            i, j = i - 1, j - 1
        elif j and (not i or table[i, j - 1] >= table[i - 1, j]):
            out.append(("", new["name"][j - 1], "new_only", new["sig"][j - 1], None, new["pos"][j - 1]))
            j -= 1
        else:
            out.append((base["name"][x], ".", "removed", base["sig"][x], base["pos"][x], None))
            i -= 1
    return _matches(rows["pair_id"].iloc[0], [(k, *m) for k, m in enumerate(reversed(out))])


def _matches(pair: int, rows: list[tuple]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=["ord", "baseline", "new", "match_type", "sig", "base_pos", "new_pos"])
    df.insert(0, "pair_id", pair)
    return df.astype({"base_pos": "Int64", "new_pos": "Int64"})


def align(kernels: DataFrame) -> DataFrame:
    """Matches of each pair by alignment of signatures; ``kernels``: (pair_id, side, pos, name, sig).

    A pair is two cycles, which one task holds; pairs run in parallel.
    """
    return kernels.groupBy("pair_id").applyInPandas(_align, MATCH_SCHEMA)


def _greedy(rows: pd.DataFrame) -> pd.DataFrame:
    base, new = _sides(rows)
    free, out = list(range(len(base))), []
    for k in range(len(new)):
        name = new["name"][k]
        found = next((x for x in free if base["name"][x] == name), free[0] if free else None)
        if found is None:
            out.append((0, "", name, "new_only", new["sig"][k], None, new["pos"][k]))
        else:
            free.remove(found)
            out.append((0, base["name"][found], name, "exact" if base["name"][found] == name else "similar", new["sig"][k], base["pos"][found], new["pos"][k]))
    out += [(1, base["name"][x], ".", "removed", base["sig"][x], base["pos"][x], None) for x in free]
    return _matches(rows["pair_id"].iloc[0], out)


def match(kernels: DataFrame) -> DataFrame:
    """Matches of each pair in the order of the new side: the first unused of the same name, else of the same signature.

    A kernel can only meet others of its signature, so signatures are folded apart and in
    parallel; what is left of the baseline follows at the end.
    """
    parts = kernels.groupBy("pair_id", "sig").applyInPandas(_greedy, MATCH_SCHEMA)
    order = Window.partitionBy("pair_id").orderBy("ord", F.coalesce("new_pos", "base_pos"))
    return parts.withColumn("ord", (F.row_number().over(order) - 1).cast("long"))


def compare(kernels: DataFrame, mode: str = "align") -> DataFrame:
    """Matches with both sides' durations and their change; any mode but ``align`` matches by signature.

    ``kernels``: (pair_id, side, pos, name, avg_dur, min_dur, max_dur, stddev). Durations of a
    side that has no kernel are 0.
    """
    signed = kernels.withColumn("sig", signature(F.col("name")))
    found = (align if mode == "align" else match)(signed.select("pair_id", "side", "pos", "name", "sig"))
    for side, at, p in (("baseline", "base_pos", "base"), ("new", "new_pos", "new")):
        own = kernels.where(F.col("side") == side).select("pair_id", F.col("pos").alias(at), *[F.col(c).alias(f"{p}_{s}") for c, s in zip(("avg_dur", "min_dur", "max_dur", "stddev"), STATS, strict=True)])
        found = found.join(own, ["pair_id", at], "left").fillna(0.0, [f"{p}_{s}" for s in STATS])
    change = change_percent(F.col("base_avg"), F.col("new_avg"))
    return found.withColumn("change_pct", change).withColumn("change_class", F.when(F.col("match_type") == "new_only", "neutral").when(F.col("match_type") == "removed", "improved").otherwise(change_class(F.col("change_pct"))))


def compare_traces(baseline: DataFrame, new: DataFrame, mode: str = "align") -> DataFrame:
    """Matches of the standard cycles of two traces of one trace each, pair 0; empty sides match nothing."""
    sides = []
    for side, events in (("baseline", baseline), ("new", new)):
        found, instances = standard_instances(events)
        s = cycle_stats(events, found, instances)
        sides.append(s.select(F.lit(0).cast("long").alias("pair_id"), F.lit(side).alias("side"), F.col("index").alias("pos"), "name", "avg_dur", "min_dur", "max_dur", "stddev"))
    return compare(sides[0].unionByName(sides[1]), mode)


def match_type_counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy("pair_id", "match_type").agg(F.count("*").alias("cnt"))


def compare_totals(matches: DataFrame) -> DataFrame:
    """(pair_id, base_kernels, new_kernels, base_time, new_time) of each pair."""
    return matches.groupBy("pair_id").agg(F.count("base_pos").alias("base_kernels"), F.count("new_pos").alias("new_kernels"), F.sum("base_avg").alias("base_time"), F.sum("new_avg").alias("new_time"))


def top_matches(matches: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` matches of each pair of the longest new durations above 0."""
    order = Window.partitionBy("pair_id").orderBy(F.desc("new_avg"), "ord")
    return matches.where("new_avg > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def numbered_pairs(baseline: DataFrame, new: DataFrame) -> DataFrame:
    """Kernels of the cycles of two runs paired by their number (cycle_no); numbers that one side lacks are left out."""
    both = baseline.select("cycle_no").distinct().join(new.select("cycle_no").distinct(), "cycle_no")
    sides = [df.join(both, "cycle_no", "left_semi").withColumn("side", F.lit(s)) for df, s in ((baseline, "baseline"), (new, "new"))]
    return sides[0].unionByName(sides[1]).withColumnRenamed("cycle_no", "pair_id")
