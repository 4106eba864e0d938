"""Spark-native analytics for nanopore raw-signal data."""
