"""Weighted Jaccard similarity of cycles, merging of similar ones, and greedy pairing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewheel.operators.anchors import div

MERGE_AT = 0.80
PAIR_AT = 0.2


def signature_weights(template: DataFrame) -> DataFrame:
    """(trace_id, cycle_id, sig, weight): per cent of the template's duration by signature."""
    sums = template.groupBy("trace_id", "cycle_id", "sig").agg(F.sum("dur").alias("d"))
    total = F.sum("d").over(Window.partitionBy("cycle_id"))
    return sums.withColumn("t", total).select("trace_id", "cycle_id", "sig", F.when(F.col("t") > 0, F.col("d") / F.col("t") * 100).otherwise(F.col("d")).alias("weight"))


def weighted_jaccard(left: DataFrame, right: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, l, r, sim) of all pairs of cycles that share a signature: sum of least over sum of greatest weights.

    ``left``: (keys, l, sig, weight); ``right``: (keys, r, sig, weight). With the totals of
    either side the sum of greatest is total + total - sum of least, so only shared signatures
    are joined and pairs that share none, of similarity zero, are never made.
    """
    keys = keys or []
    shared = left.withColumnRenamed("weight", "a").join(right.withColumnRenamed("weight", "b"), [*keys, "sig"]).groupBy(*keys, "l", "r").agg(F.sum(F.least("a", "b")).alias("low"))
    lt, rt = left.groupBy(*keys, "l").agg(F.sum("weight").alias("lt")), right.groupBy(*keys, "r").agg(F.sum("weight").alias("rt"))
    most = F.col("lt") + F.col("rt") - F.col("low")
    return shared.join(lt, [*keys, "l"]).join(rt, [*keys, "r"]).select(*keys, "l", "r", F.when(most > 0, F.col("low") / most).otherwise(0.0).alias("sim"))


def pattern_similarity(template: DataFrame) -> DataFrame:
    """(trace_id, l, r, sim) of the pairs of patterns of a trace."""
    w = signature_weights(template)
    return weighted_jaccard(w.withColumnRenamed("cycle_id", "l"), w.withColumnRenamed("cycle_id", "r"), ["trace_id"]).where("l <> r")


def merge_similar(patterns: DataFrame, template: DataFrame) -> DataFrame:
    """``patterns`` with similar ones merged: in order of center, start, length and signature each joins the first
    leader of like length and similarity of at least 0.8; of each group the one of most repetitions stays.

    Similarities are joined and aggregated; the fold reads a trace's patterns, one a signature.
    """
    lengths = patterns.select("trace_id", F.col("cycle_id").alias("l"), F.col("cycle_len").alias("ll"))
    others = patterns.select("trace_id", F.col("cycle_id").alias("r"), F.col("cycle_len").alias("rl"))
    near = pattern_similarity(template).where(F.col("sim") >= MERGE_AT).join(lengths, ["trace_id", "l"]).join(others, ["trace_id", "r"])
    near = near.where(F.abs(F.col("ll") - F.col("rl")) <= div(F.greatest("ll", "rl"), 5)).groupBy(F.col("l").alias("cycle_id")).agg(F.collect_list("r").alias("similar"))
    rows = patterns.join(near, "cycle_id", "left").select("trace_id", "cycle_id", "center", "start", "cycle_len", "signature", "reps", F.coalesce("similar", F.array().cast("array<string>")).alias("similar"))
    kept = rows.groupBy("trace_id").applyInPandas(_fold_leaders, "cycle_id string")
    return patterns.join(kept, "cycle_id", "left_semi")


def _fold_leaders(rows: pd.DataFrame) -> pd.DataFrame:
    leaders: dict[str, list] = {}
    for r in rows.sort_values(["center", "start", "cycle_len", "signature"]).itertuples():
        near = set(r.similar)
        lead = next((k for k in leaders if k in near), None)
        leaders.setdefault(lead if lead is not None else r.cycle_id, []).append(r)
    return pd.DataFrame({"cycle_id": [max(g, key=lambda r: r.reps).cycle_id for g in leaders.values()]}, dtype=object)


def smart_pairs(similarity: DataFrame) -> list[tuple[int, int, float]]:
    """Greedy one-to-one pairs of (l, r, sim): the most similar first, ties by l then r, at 0.2 or more; in order of l.

    One pass over the pairs in that order. The pairs are those of two lists of cycle files.
    """
    used_l, used_r, out = set(), set(), []
    for row in similarity.where(F.col("sim") >= PAIR_AT).orderBy(F.desc("sim"), "l", "r").toLocalIterator():
        if row["l"] not in used_l and row["r"] not in used_r:
            used_l.add(row["l"])
            used_r.add(row["r"])
            out.append((row["l"], row["r"], row["sim"]))
    return sorted(out)
