"""Readers and writers: traces, cycle CSV, comparison reports."""
