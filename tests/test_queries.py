import pytest
from conftest import SF, same_rows

import __spark_entry__ as entry
from tracewheel.plans.oracles import ORACLES
from tracewheel.plans.queries import QUERIES

CHOSEN = ("anchor_gaps", "consistent_anchors", "verified_cycles", "cycle_stats", "kernel_signature", "name_hash", "normalized_name", "pattern_similarity", "cycle_patterns", "phase_classification", "kmer_anchors", "quick_verify", "match_compare", "change_heatmap", "no_patterns", "distinct_kmers", "kmer_cycles", "simple_cycles", "bruteforce_cycle", "quick_probe", "standard_cycle", "pattern_stats", "align_compare", "smart_pairs", "trace_comparison", "trace_scan", "cycle_csv_lines", "cycle_csv_rows", "cycle_csv_shares", "compare_csv_lines", "sheet_cells")


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SF), duck.sql(ORACLES[name]).df())


def test_sample_statistics_equal_their_sql(spark, duck):
    same_rows(QUERIES["cycle_stats_sample"](spark, SF), duck.sql(ORACLES["cycle_stats_sample"]).df())


def test_known_results_of_the_derived_trace(spark):
    found = QUERIES["cycle_patterns"](spark, SF).collect()
    assert len(found) == 4
    assert (2400, 17, 211, 4193.5) in [(r["start"], r["cycle_len"], r["reps"], r["center"]) for r in found]
    assert [(r["start"], r["cycle_len"], r["reps"]) for r in QUERIES["simple_cycles"](spark, SF).orderBy("start").collect()][0] == (7, 24, 99)


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() == 4
    assert set(ORACLES) <= set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())
