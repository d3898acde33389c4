import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewheel.operators import compare, similarity
from tracewheel.operators.cycles import overlap
from tracewheel.plans.queries import BASELINE, CHANGED


def kernels(spark, *pairs):
    rows = [(p, s, k, n, float(k + 1), 1.0, 2.0, 0.0) for p, sides in enumerate(pairs) for s, names in zip(("baseline", "new"), sides, strict=True) for k, n in enumerate(names)]
    return spark.createDataFrame(rows, "pair_id long, side string, pos long, name string, avg_dur double, min_dur double, max_dur double, stddev double")


def test_alignment_of_the_short_cycles(spark):
    rows = compare.compare(kernels(spark, (BASELINE, CHANGED)), "align").orderBy("ord").collect()
    assert [(r["baseline"], r["new"], r["match_type"]) for r in rows] == [
        ("gemm<a,1>", "gemm<c,3>", "similar"), ("gemm<b,2>", "gemm<a,1>", "similar"), ("softmax_0", "softmax_1", "similar"), ("copy_k", ".", "removed"),
        ("", "fused_new", "new_only"), ("act_32x64", "act_16x64", "similar"), ("norm<1>", "norm<1>", "exact"),
    ]


def plain_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=12))
def test_lcs_table(a, b):
    got = int(compare.lcs_table(np.array(a, int), np.array(b, int))[-1, -1])
    assert got == plain_lcs(a, b) == plain_lcs(b, a)


def plain_match(base, new, sig):
    used, out = set(), []
    for n in new:
        k = next((k for k, b in enumerate(base) if k not in used and b == n), None)
        k = next((k for k, b in enumerate(base) if k not in used and sig(b) == sig(n)), None) if k is None else k
        used.add(k)
        out.append(("", n, "new_only") if k is None else (base[k], n, "exact" if base[k] == n else "similar"))
    return out + [(b, ".", "removed") for k, b in enumerate(base) if k not in used]


def test_greedy_matching_equals_a_plain_loop(spark):
    rng = random.Random(3)
    names = [f"kern_{c}<{v}>" for c in "abc" for v in range(3)]
    pairs = [([rng.choice(names) for _ in range(rng.randrange(1, 9))], [rng.choice(names) for _ in range(rng.randrange(1, 9))]) for _ in range(8)]
    rows = compare.compare(kernels(spark, *pairs), "match").orderBy("pair_id", "ord").collect()
    for p, (b, n) in enumerate(pairs):
        assert [(r["baseline"], r["new"], r["match_type"]) for r in rows if r["pair_id"] == p] == plain_match(b, n, lambda x: x.split("<")[0])
    counts = {(r["pair_id"], r["match_type"]): r["cnt"] for r in compare.match_type_counts(compare.compare(kernels(spark, *pairs), "align")).collect()}
    for p, (b, n) in enumerate(pairs):
        both = counts.get((p, "exact"), 0) + counts.get((p, "similar"), 0)
        assert both + counts.get((p, "removed"), 0) == len(b) and both + counts.get((p, "new_only"), 0) == len(n)


def test_pairs_are_greedy(spark):
    sims = spark.createDataFrame([(0, 0, 0.9), (0, 1, 0.8), (1, 0, 0.85), (1, 1, 0.1)], "l long, r long, sim double")
    assert similarity.smart_pairs(sims) == [(0, 0, 0.9)]


def test_overlap_of_signatures():
    assert overlap("a|b|c|d|e", "a|b|c|d|x") and not overlap("a|b|c|d|e", "a|b|c|x|y")
