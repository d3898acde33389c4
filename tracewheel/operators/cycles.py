"""Cycle detection: patterns with their sub-cycles, outer cycle, k-mer, simple and exhaustive detectors."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewheel.functions.names import cut_bytes, signature
from tracewheel.operators.anchors import MIN_LENGTH, anchor_gaps, consistent_anchors, div, steady, trace_sizes, with_previous
from tracewheel.operators.similarity import merge_similar
from tracewheel.operators.stats import contiguous_instances
from tracewheel.operators.verify import consecutive_repetitions, loose_repetitions, repetition_matches
from tracewheel.storage import small_join, staged

SUB_CYCLE_ABOVE = 20


def signed_events(events: DataFrame) -> DataFrame:
    """``events`` with sig, worked out once a distinct name."""
    names = staged(events.select("name").distinct().withColumn("sig", signature(F.col("name"))), "names")
    return small_join(events, names, ["name"]).select("trace_id", "seq", "name", "dur", "sig")


def verified_anchors(events: DataFrame, least_reps: int = 5) -> tuple[DataFrame, DataFrame]:
    """Cycles of the consistent anchors that repeat, and their instances.

    Cycles: (trace_id, cycle_id, anchor, cnt, n_events, start, cycle_len, reps); instances:
    (trace_id, cycle_id, inst), inst the first event. cycle_id numbers them in candidate order
    (count descending, then name).
    """
    found = consistent_anchors(events).withColumnsRenamed({"name": "anchor"})
    order = Window.partitionBy("trace_id").orderBy(F.desc("cnt"), "anchor")
    found = staged(found.withColumn("cycle_id", F.concat_ws(":", "trace_id", F.format_string("%08d", F.row_number().over(order)))), "anchors")
    reps = staged(loose_repetitions(repetition_matches(events, found), found.withColumnRenamed("cnt", "expected")), "repetitions")
    counts = reps.groupBy("cycle_id").agg(F.count("*").alias("reps")).where(F.col("reps") >= least_reps)
    cycles = staged(found.join(counts, "cycle_id"), "cycles")
    instances = reps.join(cycles.select("cycle_id", "start", "cycle_len"), "cycle_id").select("trace_id", "cycle_id", (F.col("start") + F.col("rep") * F.col("cycle_len")).alias("inst"))
    return cycles, instances


def template_rows(signed: DataFrame, cycles: DataFrame) -> DataFrame:
    """(trace_id, cycle_id, cycle_len, off, name, sig, dur) of the first repetition."""
    places = cycles.select("trace_id", "cycle_id", "cycle_len", F.posexplode(F.sequence(F.col("start"), F.col("start") + F.col("cycle_len") - 1)).alias("off", "seq"))
    return places.join(signed, ["trace_id", "seq"]).select("trace_id", "cycle_id", "cycle_len", F.col("off").cast("long").alias("off"), "name", "sig", "dur")


def sub_cycles(template: DataFrame) -> DataFrame:
    """(cycle_id, sub_start, sub_len, offsets): the shortest sub-cycle of each template, the earliest among equals.

    A signature that recurs at least three times at steady distance proposes its first gap;
    at least three successive windows must equal the next by signature, four fifths of them.
    """
    t = template.where(F.col("cycle_len") > SUB_CYCLE_ABOVE)
    before = Window.partitionBy("cycle_id", "sig").orderBy("off")
    gaps = t.withColumn("gap", F.col("off") - F.lag("off").over(before))
    found = gaps.groupBy("cycle_id", "cycle_len", "sig").agg(F.count("*").alias("n"), F.min("off").alias("sub_start"), F.min_by("gap", F.when(F.col("gap").isNotNull(), F.col("off"))).alias("sub_len"), F.min("gap").alias("low"), F.max("gap").alias("high"), F.sort_array(F.collect_list("off")).alias("offsets"))
    found = found.where((F.col("n") >= 3) & (F.col("sub_len") >= 5) & (F.col("sub_len") < div("cycle_len", 2)) & steady(F.col("sub_len"), F.col("low"), F.col("high"), 10))
    found = found.select("cycle_id", "cycle_len", "sig", "sub_start", "sub_len", "offsets")
    here = found.select("cycle_id", "sig", "cycle_len", "sub_start", "sub_len").join(t.select("cycle_id", "off", F.col("sig").alias("a")), "cycle_id").where("off >= sub_start")
    there = t.select("cycle_id", (F.col("off")).alias("next"), F.col("sig").alias("b"))
    at = F.col("off") - F.col("sub_start")
    pairs = here.withColumns({"next": F.col("off") + F.col("sub_len"), "step": div(at, F.col("sub_len"))}).where("sub_start + step * sub_len + sub_len < cycle_len").join(there, ["cycle_id", "next"])
    steps = pairs.groupBy("cycle_id", "sig", "sub_len", "step").agg(F.sum((F.col("a") == F.col("b")).cast("long")).alias("same")).where(F.col("same") >= 0.8 * F.col("sub_len"))
    good = steps.groupBy("cycle_id", "sig").agg(F.count("*").alias("steps")).where("steps >= 3")
    best = found.join(good, ["cycle_id", "sig"]).groupBy("cycle_id").agg(F.min(F.struct("sub_len", "sub_start", "offsets")).alias("s"))
    return best.select("cycle_id", "s.sub_start", "s.sub_len", "s.offsets")


def pattern_signatures(signed: DataFrame, patterns: DataFrame) -> DataFrame:
    """(cycle_id, signature): the first ten signatures joined by bars; empty if the cycle passes the end."""
    first = patterns.select("trace_id", "cycle_id", F.explode(F.sequence(F.col("start"), F.col("start") + F.least(F.col("cycle_len"), F.lit(10)) - 1)).alias("seq"))
    joined = first.join(signed, ["trace_id", "seq"]).groupBy("cycle_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "sig"))), lambda x: x["sig"]), "|").alias("s"))
    return patterns.join(joined, "cycle_id", "left").select("cycle_id", F.when(F.col("start") + F.col("cycle_len") <= F.col("n_events"), F.coalesce("s", F.lit(""))).otherwise("").alias("signature"))


def signature_groups(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Patterns before merging: the best of each signature; with their instances, and the events signed.

    Patterns: (trace_id, cycle_id, anchor, start, cycle_len, reps, n_events, signature, start_pos, end_pos, center).
    """
    signed = staged(signed_events(events), "signed")
    cycles, instances = verified_anchors(signed)
    subs = staged(sub_cycles(template_rows(signed, cycles)), "subs")
    both = cycles.join(subs, "cycle_id", "left")
    inner = F.col("sub_len").isNotNull()
    patterns = both.select("trace_id", "cycle_id", "anchor", "n_events", F.when(inner, F.col("start") + F.col("sub_start")).otherwise(F.col("start")).alias("start"), F.coalesce("sub_len", "cycle_len").alias("cycle_len"), F.when(inner, F.size("offsets") * F.col("reps")).otherwise(F.col("reps")).alias("reps"))
    offsets = F.explode(F.coalesce("offsets", F.array(F.lit(0).cast("long"))))
    instances = staged(instances.join(subs.select("cycle_id", "offsets"), "cycle_id", "left").select("trace_id", "cycle_id", "inst", offsets.alias("o")).select("trace_id", "cycle_id", (F.col("inst") + F.col("o")).alias("inst")), "instances")
    ends = instances.groupBy("cycle_id").agg(F.max("inst").alias("last"))
    patterns = staged(patterns, "patterns")
    named = patterns.join(pattern_signatures(signed, patterns), "cycle_id").join(ends, "cycle_id")
    named = named.withColumns({"start_pos": F.col("start"), "end_pos": F.col("last") + F.col("cycle_len")}).withColumn("center", (F.col("start_pos") + F.col("end_pos")) / 2.0).drop("last")
    best = Window.partitionBy("trace_id", "signature").orderBy(F.desc("reps"), "cycle_id")
    return staged(named.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r"), "groups"), instances, signed


def cycle_patterns(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All patterns of each trace, similar ones merged; with instances and signed events."""
    groups, instances, signed = signature_groups(events)
    return merge_similar(groups, template_rows(signed, groups)), instances, signed


def outer_cycle(events: DataFrame, phase: str = "auto") -> DataFrame:
    """One cycle a trace, of most repetitions, or of fewest for ``prefill``; anchors need six positions."""
    return best_outer(verified_anchors(events)[0], phase)


def best_outer(cycles: DataFrame, phase: str) -> DataFrame:
    order = [F.asc("reps") if phase == "prefill" else F.desc("reps"), F.asc("cycle_id")]
    best = Window.partitionBy("trace_id").orderBy(*order)
    return cycles.where("cnt >= 6").withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


def standard_instances(events: DataFrame, phase: str = "auto") -> tuple[DataFrame, DataFrame]:
    """One cycle a trace (trace_id, cycle_id, start, cycle_len, reps, kind) and its instances (trace_id, cycle_id, inst).

    The outer cycle or its sub-cycle; where there is none, the exhaustive search.
    """
    signed = staged(signed_events(events), "signed")
    cycles, instances = verified_anchors(signed)
    outer = staged(best_outer(cycles, phase), "outer")
    subs = staged(sub_cycles(template_rows(signed, outer)), "subs")
    found = outer.join(subs, "cycle_id", "left").select("trace_id", "cycle_id", (F.col("start") + F.coalesce("sub_start", F.lit(0))).alias("start"), F.coalesce("sub_len", "cycle_len").alias("cycle_len"), (F.col("reps") * F.coalesce(F.size("offsets"), F.lit(1))).alias("reps"), F.when(F.col("sub_len").isNull(), "outer").otherwise("sub").alias("kind"))
    offsets = F.explode(F.coalesce("offsets", F.array(F.lit(0).cast("long")))).alias("o")
    insts = instances.join(outer.select("cycle_id"), "cycle_id", "left_semi").join(subs.select("cycle_id", "offsets"), "cycle_id", "left").select("trace_id", "cycle_id", "inst", offsets).select("trace_id", "cycle_id", (F.col("inst") + F.col("o")).alias("inst"))
    rest = staged(auto_cycle(events.join(outer.select("trace_id"), "trace_id", "left_anti")).select("trace_id", F.concat_ws(":", "trace_id", "start", "cycle_len").alias("cycle_id"), "start", "cycle_len", "reps", F.lit("exhaustive").alias("kind")), "rest")
    return found.unionByName(rest), insts.unionByName(contiguous_instances(rest))


def standard_cycle(events: DataFrame, phase: str = "auto") -> DataFrame:
    """(trace_id, start, cycle_len, reps, kind) of the standard detector."""
    return standard_instances(events, phase)[0].drop("cycle_id")


def phases(patterns: DataFrame) -> DataFrame:
    """(trace_id, phase, cycle_id): the earliest pattern by center is prefill, the latest decode."""
    order = ["center", "start", "cycle_len", "signature"]
    ends = patterns.groupBy("trace_id").agg(F.min_by("cycle_id", F.struct(*order)).alias("prefill"), F.max_by("cycle_id", F.struct("center", *[-F.col(c) for c in order[1:3]], "signature")).alias("decode"))
    return ends.select("trace_id", F.explode(F.array(F.struct(F.lit("prefill").alias("phase"), F.col("prefill").alias("cycle_id")), F.struct(F.lit("decode").alias("phase"), F.col("decode").alias("cycle_id")))).alias("p")).select("trace_id", "p.*")


def classify(patterns: DataFrame) -> DataFrame:
    """(trace_id, phase, cycle_id): prefill and decode among the patterns that cover a hundredth of the trace.

    If none does, all count. Prefill is the earliest center, decode the latest of another
    signature; a phase that is missing takes the other's pattern. Ties go to the first in order.
    """
    wide = F.col("reps") * F.col("cycle_len") >= div("n_events", 100)
    p = patterns.withColumn("wide", wide).withColumn("any", F.max("wide").over(Window.partitionBy("trace_id"))).where("wide or not any")
    order = ["center", "start", "cycle_len", "signature"]
    first = Window.partitionBy("trace_id").orderBy(*order)
    last = Window.partitionBy("trace_id").orderBy(F.desc("center"), *order[1:])
    prefill = p.withColumn("r", F.row_number().over(first)).where("r = 1").select("trace_id", F.col("cycle_id").alias("prefill"), F.col("signature").alias("_sig"))
    others = p.join(prefill, "trace_id").where("signature <> _sig")
    decode = others.withColumn("r", F.row_number().over(last)).where("r = 1").select("trace_id", F.col("cycle_id").alias("decode"))
    both = prefill.join(decode, "trace_id", "left").select("trace_id", "prefill", F.coalesce("decode", "prefill").alias("decode"))
    return both.select("trace_id", F.explode(F.array(F.struct(F.lit("prefill").alias("phase"), F.col("prefill").alias("cycle_id")), F.struct(F.lit("decode").alias("phase"), F.col("decode").alias("cycle_id")))).alias("p")).select("trace_id", "p.*")


def kmer_rows(events: DataFrame, k: int) -> DataFrame:
    """(trace_id, seq, kmer): each k successive names, an array. Successors come by equi-joins on seq, not one window."""
    out = events.select("trace_id", "seq", F.array("name").alias("kmer"))
    for j in range(1, k):
        out = out.join(events.select("trace_id", (F.col("seq") - j).alias("seq"), F.col("name").alias("_n")), ["trace_id", "seq"]).select("trace_id", "seq", F.concat("kmer", F.array("_n")).alias("kmer"))
    return out


def distinct_kmers(events: DataFrame, k: int = 3) -> DataFrame:
    """(trace_id, kmers): how many different runs of ``k`` names each trace has."""
    return kmer_rows(events, k).select("trace_id", "kmer").distinct().groupBy("trace_id").agg(F.count("*").alias("kmers"))


def kmer_anchors(events: DataFrame, k: int = 3, min_length: int = MIN_LENGTH) -> DataFrame:
    """(trace_id, kmer, start, cycle_len, score): k-mers of which four fifths of the gaps are within a tenth of the first."""
    rows, key = staged(kmer_rows(events, k), "kmer-rows"), ["trace_id", "kmer"]
    gaps = staged(anchor_gaps(rows, rows.groupBy(*key).count().where("count >= 5"), key), "kmer-gaps")
    firsts = gaps.groupBy(*key).agg(F.min("seq").alias("start"), F.min_by("gap", F.when(F.col("gap").isNotNull(), F.col("seq"))).alias("cycle_len"), F.count("*").alias("p"))
    big = trace_sizes(events).where(F.col("n_events") >= 2 * min_length + k).select("trace_id")
    firsts = staged(firsts.where(F.col("cycle_len") >= min_length).join(big, "trace_id"), "kmer-firsts")
    near = F.abs(F.col("gap") - F.col("cycle_len")) <= F.greatest(F.lit(1).cast("long"), div("cycle_len", 10))
    found = small_join(gaps.where("gap is not null"), firsts, key).groupBy(*key, "start", "cycle_len", "p").agg((F.sum(near.cast("long")) - 1).alias("score"))
    return found.where(F.col("score") >= 0.8 * (F.col("p") - 1)).select("trace_id", "kmer", "start", "cycle_len", "score")


def kmer_cycles(events: DataFrame, k: int = 3, min_length: int = MIN_LENGTH) -> DataFrame:
    """(trace_id, anchor, start, cycle_len, reps): k-mer cycles, the best-scored first to claim its range, like ones merged.

    Ranges are claimed by the thousand events, and a cycle whose first thousand is claimed is
    left out; so of the verified candidates that start in one thousand only the best can count,
    and a trace's fold reads a row a thousand events at most.
    """
    anchors = kmer_anchors(events, k, min_length).withColumn("cycle_id", F.concat_ws(":", "trace_id", "start", "cycle_len"))
    anchors = staged(anchors.withColumn("anchor", cut_bytes(F.get("kmer", 0), 50)), "kmers")
    reps = consecutive_repetitions(repetition_matches(events, anchors)).where("reps >= 5")
    best = F.row_number().over(Window.partitionBy("trace_id", div("start", 1000)).orderBy(F.desc("score"), "start"))
    good = staged(anchors.join(reps, ["trace_id", "cycle_id"]).withColumn("r", best).where("r = 1"), "kmer-cycles")
    first = good.select("trace_id", "cycle_id", F.explode(F.sequence(F.col("start"), F.col("start") + F.least(F.col("cycle_len"), F.lit(10)) - 1)).alias("seq"))
    sigs = first.join(events, ["trace_id", "seq"]).groupBy("cycle_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", cut_bytes(F.col("name"), 30).alias("n")))), lambda x: x["n"]), "|").alias("sig"))
    rows = good.join(sigs, "cycle_id").select("trace_id", "anchor", "start", "cycle_len", "score", "reps", "sig")
    return rows.groupBy("trace_id").applyInPandas(_fold_kmers, "trace_id long, anchor string, start long, cycle_len long, reps long")


def _fold_kmers(rows: pd.DataFrame) -> pd.DataFrame:
    used: set[int] = set()
    kept = []
    for r in rows.sort_values(["score", "start"], ascending=[False, True]).itertuples():
        if r.start // 1000 in used:
            continue
        used.update(at // 1000 for at in range(r.start, r.start + r.cycle_len * r.reps, 1000))
        kept.append(r)
    groups: list[list] = []
    for r in sorted(kept, key=lambda r: r.start):
        for g in groups:
            lead = g[0]
            if abs(r.cycle_len - lead.cycle_len) <= max(lead.cycle_len // 5, 2) and overlap(lead.sig, r.sig):
                g.append(r)
                break
        else:
            groups.append([r])
    best = [max(g, key=lambda r: r.reps) for g in groups]  # the first of most repetitions
    best.sort(key=lambda r: (r.start + r.cycle_len * r.reps // 2, r.start))
    return pd.DataFrame([(r.trace_id, r.anchor, r.start, r.cycle_len, r.reps) for r in best], columns=["trace_id", "anchor", "start", "cycle_len", "reps"])


def overlap(a: str, b: str) -> bool:
    """Whether four fifths of the parts of ``a``, at least one, are among those of ``b``."""
    parts, others = a.split("|"), set(b.split("|"))
    return sum(p in others for p in parts) >= max(1, len(parts) * 8 // 10)


def simple_cycles(events: DataFrame, min_length: int = MIN_LENGTH, batch: int = 64) -> DataFrame:
    """(trace_id, start, cycle_len, reps): from each place on, the first repeat of a name that starts five repetitions.

    Scanning goes on behind each cycle found. Candidates are the distances of equal names next
    to each other, in the order of the second. Round by round, the next candidates of every
    trace that is not done are verified in one join, four times as many in each round that
    finds nothing; rounds are as many as the trace of most cycles needs, whatever the number of
    traces.
    """
    pairs = with_previous(events, ["trace_id", "name"]).where(F.col("seq") - F.col("prev") >= min_length)
    pairs = staged(pairs.select("trace_id", F.col("prev").alias("start"), F.col("seq").alias("i"), (F.col("seq") - F.col("prev")).alias("cycle_len")), "repeats")
    state = staged(trace_sizes(events).select("trace_id", (F.col("n_events") - 2 * min_length).alias("most"), F.lit(0).cast("long").alias("at"), F.lit(-1).cast("long").alias("seen")), "scan")
    done: list[DataFrame] = []
    size = batch
    while True:
        live = state.where("at < most")
        ahead = small_join(pairs, live, ["trace_id"], (F.col("start") >= F.col("at")) & (F.col("i") > F.col("seen")))
        order = Window.partitionBy("trace_id").orderBy("i")
        # A bound that is a constant is applied where rows lie, before they are shuffled.
        tried = ahead.select("trace_id", "start", "i", "cycle_len").withColumn("r", F.row_number().over(order)).where(F.col("r") <= size)
        tried = staged(tried.withColumn("cycle_id", F.concat_ws(":", "trace_id", "i")), "tried")
        if not tried.limit(1).count():
            break
        # Five repetitions are looked for in all candidates, and all repetitions of the first that has them.
        good = consecutive_repetitions(repetition_matches(events, tried, first_reps=5)).where("reps >= 5")
        found = tried.join(good, ["trace_id", "cycle_id"]).groupBy("trace_id").agg(F.min(F.struct("i", "start", "cycle_len", "cycle_id")).alias("f"))
        found = staged(found.select("trace_id", "f.start", "f.cycle_len", "f.cycle_id"), "found")
        hits = found.count()
        if hits:
            reps = consecutive_repetitions(repetition_matches(events, found))
            found = staged(found.join(reps, ["trace_id", "cycle_id"]).drop("cycle_id"), "found")
            done.append(found.select("trace_id", "start", "cycle_len", "reps"))
        else:
            found = found.select("trace_id", "start", "cycle_len", F.lit(0).cast("long").alias("reps"))
        tops = tried.groupBy("trace_id").agg(F.max("i").alias("top"))
        hit = F.col("reps").isNotNull()
        moved = live.join(tops, "trace_id").join(found, "trace_id", "left")
        state = staged(moved.select("trace_id", "most", F.when(hit, F.col("start") + F.col("cycle_len") * F.col("reps")).otherwise(F.col("at")).alias("at"), F.when(hit, F.lit(-1).cast("long")).otherwise(F.col("top")).alias("seen")), "scan")
        size = batch if hits else size * 4
    out = events.sparkSession.createDataFrame([], "trace_id long, start long, cycle_len long, reps long")
    for found in done:
        out = out.unionByName(found)
    return out


def first_repeats(events: DataFrame) -> DataFrame:
    """(trace_id, first_repeat): the first place whose name has stood before."""
    # The second place of a name is the least that is not its first, so counts of each task suffice.
    firsts = staged(events.groupBy("trace_id", "name").agg(F.min("seq").alias("first")), "firsts")
    later = small_join(events, firsts, ["trace_id", "name"]).where("seq > first")
    return later.groupBy("trace_id").agg(F.min("seq").alias("first_repeat"))


def exhaustive_cycle(events: DataFrame, bounds: DataFrame) -> DataFrame:
    """(trace_id, start, cycle_len, reps): the shortest length within ``bounds`` (trace_id, low, high), then the first
    offset below it and a quarter of the trace, of at least two exact repetitions.

    Names equal to the ones a length later, from an offset through a whole length, are two
    repetitions; only the first three lengths of the trace can hold such an offset.
    """
    sizes = trace_sizes(events)
    lengths = bounds.join(sizes, "trace_id").withColumn("high", F.least("high", div("n_events", 2))).where("low <= high")
    lengths = lengths.select("trace_id", "n_events", F.explode(F.sequence("low", "high")).alias("cycle_len"))
    near = small_join(events.select("trace_id", "seq", "name"), lengths, ["trace_id"], F.col("seq") < 2 * F.col("cycle_len"))
    later = events.select("trace_id", F.col("seq").alias("then"), F.col("name").alias("after"))
    pairs = near.withColumn("then", F.col("seq") + F.col("cycle_len")).join(later, ["trace_id", "then"], "left")
    wrong = pairs.where("after is null or after <> name").select("trace_id", "cycle_len", "n_events", "seq")
    before = Window.partitionBy("trace_id", "cycle_len").orderBy("seq")
    ends = wrong.unionByName(lengths.select("trace_id", "cycle_len", "n_events", (2 * F.col("cycle_len")).alias("seq")))
    free = ends.withColumn("from", F.coalesce(F.lag("seq").over(before) + 1, F.lit(0))).where("seq - from >= cycle_len and from < least(cycle_len, n_events div 4)")
    best = free.groupBy("trace_id").agg(F.min(F.struct("cycle_len", "from")).alias("b")).select("trace_id", F.col("b.from").alias("start"), "b.cycle_len")
    best = staged(best.withColumn("cycle_id", F.col("trace_id").cast("string")), "exhaustive")
    reps = consecutive_repetitions(repetition_matches(events, best), 1.0)
    return best.join(reps, ["trace_id", "cycle_id"]).select("trace_id", "start", "cycle_len", "reps")


def auto_cycle(events: DataFrame) -> DataFrame:
    """The exhaustive search around the first repeated name, for traces of twenty events or more."""
    sizes = trace_sizes(events).where("n_events >= 20").join(first_repeats(events), "trace_id")
    low = F.greatest(F.lit(MIN_LENGTH).cast("long"), F.col("first_repeat") - 100)
    return exhaustive_cycle(events, sizes.select("trace_id", low.alias("low"), F.least(div("n_events", 2), F.col("first_repeat") + 1000).alias("high")))


def quick_probe(events: DataFrame, min_cycle: int = 50, max_cycle: int = 5000) -> DataFrame:
    """(trace_id, name, start, cycle_len, reps): the first distance, by name and length, seen four times or more that
    starts five repetitions, for traces of three times the shortest cycle."""
    sizes = trace_sizes(events).where(F.col("n_events") >= 3 * min_cycle)
    names = events.groupBy("trace_id", "name").agg(F.count("*").alias("c"), F.min("seq").alias("start")).where("c >= 5").join(sizes, "trace_id")
    gaps = anchor_gaps(events, names).where(F.col("gap").between(min_cycle, max_cycle)).groupBy("trace_id", "name", "gap").agg(F.count("*").alias("hits")).where("hits >= 4")
    tried = gaps.join(names, ["trace_id", "name"]).where("start + 3 * gap <= n_events").withColumn("cycle_id", F.concat_ws(":", "trace_id", "start", "gap"))
    tried = staged(tried.withColumnRenamed("gap", "cycle_len"), "probe")
    reps = consecutive_repetitions(repetition_matches(events, tried)).where("reps >= 5")
    first = tried.join(reps, ["trace_id", "cycle_id"]).groupBy("trace_id").agg(F.min(F.struct("name", "cycle_len", "start", "reps")).alias("b"))
    return first.select("trace_id", "b.name", "b.start", "b.cycle_len", "b.reps")


