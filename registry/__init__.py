"""Registered queries: each pairs a Spark job over the benchmark tables with SQL that computes the same rows."""
