"""Supply-chain analytics on Spark: cleaning, feature tables, marts, scoring, retrieval and order streams.

Every public function takes DataFrames (plus explicit thresholds and an explicit as-of date) and returns a
DataFrame; nothing reads the clock and nothing is collected unless its size is bounded first.
"""
