"""Readers, writers and the binding of the benchmark tables to the supply-chain schemas."""
