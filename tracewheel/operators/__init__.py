"""Operators over event sequences: anchors, cycles, statistics, similarity, comparison."""
