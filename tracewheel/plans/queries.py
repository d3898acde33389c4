"""The registered queries: each applies one operator to a whole trace and returns plain columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewheel.functions.names import category, fnv1a_mod, is_dimension_suffix, normalized, signature, truncated
from tracewheel.operators import anchors, compare, cycles, similarity, stats
from tracewheel.operators.verify import consecutive_repetitions, repetition_matches
from tracewheel.plans.traces import event_trace, trace_files, two_phase_trace
from tracewheel.sources import cycle_csv, reports
from tracewheel.sources.traces import read_traces
from tracewheel.storage import fresh_path, staged

#: What several queries of a session start from, by application, folder and name.
_MADE: dict[tuple[str, str, str], tuple[DataFrame, ...]] = {}


def shared(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], tuple[DataFrame, ...]]) -> tuple[DataFrame, ...]:
    """Tables that queries share, each written once a session and folder, as a run over one trace would."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _MADE:
        _MADE[key] = tuple(staged(df, name) for df in make())
    return _MADE[key]


def forget_shared() -> None:
    """The next query makes the tables that it shares with others anew; the trace itself stays."""
    _MADE.clear()


Query = Callable[[SparkSession, str], DataFrame]

#: Names with an odd signature, category or number at the end.
EDGE_NAMES = (
    "void ck::kernel_gemm<int, float>", "triton_red_fused__to_copy_add_mean_mul_pow_rsqrt_0", "simple_kernel_name", "gemm_kernel<float, 128>",
    "aiter::fmoe_bf16_1tg_ps_32x256", "triton_poi_fused_add_0", "ck_tile::kentry_GROUP_K_128", "foo_SPLITK_BLOCK_SIZE_64", "a_vstack_k", "k_10", "k_1_2",
    "_BLOCK_SIZE__BLOCK_SIZE__9", "Cijk_Ailk_Bljk", "paged_attention_v1", "fmha_fwd", "softmax_warp", "rocprim::scan", "embedding_bag", "triton_1", "triton_x_12_3",
    "vectorized_elementwise_kernel<4>", "layer_norm_0", "fill_reshape", "reduce_kernel_32x64",
)

ROUND3 = {c: 3 for c in ("avg_dur", "min_dur", "max_dur", "stddev", "total_dur", "dur", "base_avg", "new_avg", "avg_cycle_time", "total_time", "base_time", "new_time")}
ROUND = ROUND3 | {c: 4 for c in ("pct_of_cycle", "pct", "sim", "change_pct", "weight")}


def plain(df: DataFrame) -> DataFrame:
    return stats.rounded(df, ROUND)


def all_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge = spark.createDataFrame([(n,) for n in EDGE_NAMES], "name string")
    return two_phase_trace(spark, sf_dir).select("name").union(edge).distinct()


def derived_trace(spark, sf):
    return two_phase_trace(spark, sf).select("seq", "name", "dur")


def kernel_counts(spark, sf):
    return anchors.kernel_counts(two_phase_trace(spark, sf)).select("name", "cnt")


def anchor_candidates(spark, sf):
    return anchors.anchor_candidates(two_phase_trace(spark, sf)).select("name", "cnt")


def anchor_gaps(spark, sf):
    e = two_phase_trace(spark, sf)
    return anchors.anchor_gaps(e, anchors.anchor_candidates(e)).select("name", "seq", "gap")


def consistent_anchors(spark, sf):
    return anchors.consistent_anchors(two_phase_trace(spark, sf)).select("name", "cnt", "start", "cycle_len")


def verified_cycles(spark, sf):
    return cycles.verified_anchors(two_phase_trace(spark, sf))[0].select("anchor", "start", "cycle_len", "reps")


def _outer(spark, sf):
    """The outer cycle, with its instances and statistics."""
    e = two_phase_trace(spark, sf)

    def make() -> tuple[DataFrame, DataFrame]:
        found, instances = cycles.verified_anchors(e)
        best = cycles.best_outer(found, "auto")
        return best, instances.join(best.select("cycle_id"), "cycle_id", "left_semi")

    return e, *shared(spark, sf, "outer", make)


def outer_cycle(spark, sf):
    return cycles.outer_cycle(two_phase_trace(spark, sf)).select("anchor", "start", "cycle_len", "reps")


def cycle_stats(spark, sf):
    e, best, instances = _outer(spark, sf)
    s = stats.cycle_stats(e, best, instances)
    return plain(stats.with_share(s, stats.cycle_header(best, s)).drop("cycle_id", "total_dur"))


def cycle_stats_sample(spark, sf):
    e, best, _ = _outer(spark, sf)
    s = staged(stats.cycle_stats(e, best, sample=True), "stats")
    return plain(stats.with_share(s, stats.cycle_header(best, s, sample=True)).drop("cycle_id", "total_dur"))


def cycle_header(spark, sf):
    e, best, instances = _outer(spark, sf)
    return plain(stats.cycle_header(best, stats.cycle_stats(e, best, instances)).drop("cycle_id"))


def top_kernels(spark, sf):
    e, best, instances = _outer(spark, sf)
    return plain(stats.top_kernels(stats.cycle_stats(e, best, instances)).select("rank", "index", "name", "avg_dur"))


def category_distribution(spark, sf):
    e, best, instances = _outer(spark, sf)
    return plain(stats.category_distribution(stats.cycle_stats(e, best, instances)).drop("cycle_id"))


def kernel_signature(spark, sf):
    return all_names(spark, sf).select("name", signature(F.col("name")).alias("sig"))


def kernel_category(spark, sf):
    return all_names(spark, sf).select("name", category(F.col("name")).alias("category"))


def normalized_name(spark, sf):
    n = F.col("name")
    return all_names(spark, sf).select("name", normalized(n).alias("normalized"), truncated(n, 30).alias("short"), is_dimension_suffix(F.substring_index(n, "_", -1)).alias("has_dimensions"))


def name_hash(spark, sf):
    return all_names(spark, sf).select("name", fnv1a_mod(F.col("name")).cast("long").alias("hash_mod"))


def sub_cycles(spark, sf):
    signed = staged(cycles.signed_events(two_phase_trace(spark, sf)), "signed")
    found, _ = cycles.verified_anchors(signed)
    subs = cycles.sub_cycles(cycles.template_rows(signed, found))
    return subs.join(found, "cycle_id").select("anchor", "start", "sub_start", "sub_len", F.size("offsets").cast("long").alias("positions"))


PATTERN = ("start", "cycle_len", "reps", "signature", "end_pos", "center")


def pattern_signature(spark, sf):
    return cycles.signature_groups(two_phase_trace(spark, sf))[0].select(*PATTERN)


def pattern_similarity(spark, sf):
    groups, _, signed = cycles.signature_groups(two_phase_trace(spark, sf))
    sims = similarity.pattern_similarity(cycles.template_rows(signed, groups))
    own = groups.select("cycle_id", "signature")
    left, right = own.select(F.col("cycle_id").alias("l"), F.col("signature").alias("left_signature")), own.select(F.col("cycle_id").alias("r"), F.col("signature").alias("right_signature"))
    return plain(sims.join(left, "l").join(right, "r").select("left_signature", "right_signature", "sim"))


def cycle_patterns(spark, sf):
    return cycles.cycle_patterns(two_phase_trace(spark, sf))[0].select(*PATTERN)


def phase_classification(spark, sf):
    patterns = staged(cycles.cycle_patterns(two_phase_trace(spark, sf))[0], "patterns")
    return cycles.classify(patterns).join(patterns, ["trace_id", "cycle_id"]).select("phase", *PATTERN)


def phase_ends(spark, sf):
    patterns = staged(cycles.cycle_patterns(two_phase_trace(spark, sf))[0], "patterns")
    return cycles.phases(patterns).join(patterns, ["trace_id", "cycle_id"]).select("phase", *PATTERN)


def pattern_stats(spark, sf):
    """Statistics of every pattern, numbered by center as its file would be."""
    patterns, instances, signed = cycles.cycle_patterns(two_phase_trace(spark, sf))
    patterns = staged(patterns, "patterns")
    s = stats.cycle_stats(signed, patterns, instances.join(patterns.select("cycle_id"), "cycle_id", "left_semi"))
    number = F.row_number().over(Window.partitionBy("trace_id").orderBy("center", "start", "cycle_len", "signature"))
    return plain(stats.with_share(s, stats.cycle_header(patterns, s)).join(patterns.select("cycle_id", number.alias("cycle_no")), "cycle_id").drop("cycle_id", "total_dur"))


def no_patterns(spark, sf):
    """The events table has names in the frequency band but no cycle."""
    return anchors.consistent_anchors(event_trace(spark, sf)).select("name", "cnt", "start", "cycle_len")


def distinct_kmers(spark, sf):
    return cycles.distinct_kmers(two_phase_trace(spark, sf)).select("kmers")


def kmer_anchors(spark, sf):
    return cycles.kmer_anchors(two_phase_trace(spark, sf)).select(F.array_join("kmer", "|").alias("kmer"), "start", "cycle_len", "score")


def kmer_cycles(spark, sf):
    return cycles.kmer_cycles(two_phase_trace(spark, sf)).drop("trace_id")


def simple_cycles(spark, sf):
    return cycles.simple_cycles(two_phase_trace(spark, sf)).drop("trace_id")


def bruteforce_cycle(spark, sf):
    return cycles.auto_cycle(two_phase_trace(spark, sf)).drop("trace_id")


def first_repeat(spark, sf):
    return cycles.first_repeats(two_phase_trace(spark, sf)).select("first_repeat")


def quick_probe(spark, sf):
    return cycles.quick_probe(two_phase_trace(spark, sf), 10, 5000).drop("trace_id")


def quick_verify(spark, sf):
    """Repetitions of 90 % in a row of each consistent anchor."""
    e = two_phase_trace(spark, sf)
    found = staged(anchors.consistent_anchors(e).withColumn("cycle_id", F.col("name")), "anchors")
    return consecutive_repetitions(repetition_matches(e, found)).join(found, ["trace_id", "cycle_id"]).select("name", "start", "cycle_len", "reps")


def standard_cycle(spark, sf):
    return cycles.standard_cycle(two_phase_trace(spark, sf)).drop("trace_id")


#: A pair of short cycles in which an exact partner is lost to an earlier similar one.
BASELINE = ("norm<1>", "gemm<a,1>", "gemm<b,2>", "softmax_0", "copy_k", "act_32x64")
CHANGED = ("gemm<c,3>", "gemm<a,1>", "softmax_1", "fused_new", "act_16x64", "norm<1>")


def compared_kernels(spark: SparkSession, sf: str) -> DataFrame:
    """Two pairs: the short cycles (1), and the outer cycle of the trace against a changed copy (2): turned by five
    places, every sixth kernel gone, every fourth of another variant, durations scaled."""
    short = [(1, s, k, n, float(k + 1), 0.5, 9.0, 0.1) for s, names in (("baseline", BASELINE), ("new", CHANGED)) for k, n in enumerate(names)]
    kind = "pair_id long, side string, pos long, name string, avg_dur double, min_dur double, max_dur double, stddev double"
    e, best, instances = _outer(spark, sf)
    [s] = shared(spark, sf, "outer-stats", lambda: (stats.cycle_stats(e, best, instances).withColumn("n", F.count("*").over(Window.partitionBy("cycle_id"))),))
    cols = ("avg_dur", "min_dur", "max_dur", "stddev")
    base = s.select(F.lit(2).cast("long").alias("pair_id"), F.lit("baseline").alias("side"), F.col("index").alias("pos"), "name", *cols)
    turned = F.pmod(F.col("index") + 5, F.col("n"))
    changed = s.where("index % 6 <> 5").select(F.lit(2).cast("long").alias("pair_id"), F.lit("new").alias("side"), turned.alias("pos"), F.when(F.col("index") % 4 == 0, F.concat("name", F.lit("<v2>"))).otherwise(F.col("name")).alias("name"), (F.col("avg_dur") * (0.9 + F.col("index") * 0.02)).alias("avg_dur"), *cols[1:])
    pos = (F.row_number().over(Window.partitionBy("side").orderBy("pos")) - 1).cast("long")
    return spark.createDataFrame(short, kind).unionByName(base).unionByName(changed.withColumn("pos", pos))


MATCH = ("pair_id", "ord", "baseline", "new", "match_type", "sig")


def align_compare(spark, sf):
    return compare.compare(compared_kernels(spark, sf), "align").select(*MATCH)


def lcs_rotation(spark, sf):
    return compare.lcs_rotation(compared_kernels(spark, sf).withColumn("sig", signature(F.col("name"))))


def numbered_pairs(spark, sf):
    """Cycles of two runs paired by number: each pair's kernels and time."""
    k = compared_kernels(spark, sf).withColumnRenamed("pair_id", "cycle_no")
    pairs = compare.numbered_pairs(k.where("side = 'baseline'").drop("side"), k.where("side = 'new' and cycle_no > 1").drop("side"))
    return plain(pairs.groupBy("pair_id", "side").agg(F.count("*").alias("kernels"), F.sum("avg_dur").alias("dur")))


def trace_comparison(spark, sf):
    """The trace's standard cycle against that of the trace without its first events."""
    e = two_phase_trace(spark, sf)
    later = e.where("seq >= 50").withColumn("seq", F.col("seq") - 50)
    return plain(compare.compare_traces(e, staged(later, "later")).select("ord", "baseline", "new", "match_type", "base_avg", "new_avg"))


def match_compare(spark, sf):
    return compare.compare(compared_kernels(spark, sf), "match").select(*MATCH)


def match_type_counts(spark, sf):
    return compare.match_type_counts(compare.compare(compared_kernels(spark, sf), "match"))


def change_heatmap(spark, sf):
    return plain(compare.compare(compared_kernels(spark, sf), "match").select("pair_id", "ord", "base_avg", "new_avg", "change_pct", "change_class"))


def compare_totals(spark, sf):
    return plain(compare.compare_totals(compare.compare(compared_kernels(spark, sf), "match")))


def top_matches(spark, sf):
    return plain(compare.top_matches(compare.compare(compared_kernels(spark, sf), "match")).select("pair_id", "rank", "new", "new_avg"))


def _weights(spark, sf):
    k = compared_kernels(spark, sf).withColumn("sig", signature(F.col("name")))
    total = F.sum("avg_dur").over(Window.partitionBy("pair_id", "side"))
    w = k.withColumn("weight", F.col("avg_dur") / total * 100).groupBy("side", "pair_id", "sig").agg(F.sum("weight").alias("weight"))
    return [w.where(F.col("side") == s).select(F.col("pair_id").alias(c), "sig", "weight") for s, c in (("baseline", "l"), ("new", "r"))]


def cycle_similarity(spark, sf):
    return plain(similarity.weighted_jaccard(*_weights(spark, sf)))


def smart_pairs(spark, sf):
    sims = similarity.weighted_jaccard(*_weights(spark, sf))
    pairs = spark.createDataFrame(similarity.smart_pairs(sims), "l long, r long, sim double")
    return plain(pairs)


def trace_scan(spark, sf):
    """The trace written as gzipped JSON files and read back."""
    return read_traces(spark, trace_files(spark, sf)).select("pid", "seq", "name", "ts", "dur", "tid")


def _lines(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(text.rstrip("\n").split("\n"), 1)), "line_no long, line string")


def _cycle_file(spark: SparkSession, sf: str) -> str:
    """The file of the outer cycle: a few dozen positions."""
    e, best, instances = _outer(spark, sf)
    s = stats.cycle_stats(e, best, instances)
    head = stats.cycle_header(best, s).collect()[0].asDict()
    return cycle_csv.cycle_csv_text(head, [r.asDict() for r in s.orderBy("index").collect()])


def cycle_csv_lines(spark, sf):
    return _lines(spark, _cycle_file(spark, sf))


def _read_back(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    path = fresh_path(spark, "cycle-csv")
    spark.createDataFrame([(_cycle_file(spark, sf),)], "value string").coalesce(1).write.text(path)
    return cycle_csv.read_cycles(spark, path)


def cycle_csv_rows(spark, sf):
    """The file of the outer cycle, read back."""
    return _read_back(spark, sf)[0].drop("path")


def cycle_csv_shares(spark, sf):
    """Shares by signature of the file read back, without its first kernel."""
    shares = cycle_csv.signature_shares(_read_back(spark, sf)[0])
    return shares.select("sig", F.round("weight", 3).alias("weight"))


def _matches(spark: SparkSession, sf: str, pair: int) -> list[dict]:
    found = compare.compare(compared_kernels(spark, sf).where(F.col("pair_id") == pair), "match")
    return [r.asDict() for r in found.orderBy("ord").collect()]  # positions of two cycles


def compare_csv_lines(spark, sf):
    return _lines(spark, reports.compare_csv_text(_matches(spark, sf, 2)))


def sheet_cells(spark, sf):
    """Every cell of the sheet that compares the short cycles, numbers to three decimals."""
    info = {"base_reps": 3, "new_reps": 4, "base_cycle_time": 21.0, "new_cycle_time": 20.0}
    cells = [(r, c, f"{v:.3f}" if isinstance(v, float) else v, style) for r, c, v, style in reports.sheet_cells(_matches(spark, sf, 1), info)]
    return spark.createDataFrame(cells, "row long, col string, value string, style string")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        cycle_patterns, derived_trace, kernel_counts, anchor_candidates, anchor_gaps, consistent_anchors, verified_cycles, outer_cycle, cycle_stats, cycle_stats_sample,
        cycle_header, top_kernels, category_distribution, kernel_signature, kernel_category, normalized_name, name_hash, sub_cycles, pattern_signature,
        pattern_similarity, phase_classification, phase_ends, pattern_stats, no_patterns, distinct_kmers, kmer_anchors, kmer_cycles, simple_cycles, bruteforce_cycle, first_repeat,
        quick_probe, quick_verify, standard_cycle, align_compare, lcs_rotation, numbered_pairs, trace_comparison, match_compare, match_type_counts, change_heatmap, compare_totals, top_matches, cycle_similarity, smart_pairs,
        trace_scan, cycle_csv_lines, cycle_csv_rows, cycle_csv_shares, compare_csv_lines, sheet_cells,
    )
}
