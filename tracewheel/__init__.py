"""Spark-native analysis of ordered kernel-event traces."""
