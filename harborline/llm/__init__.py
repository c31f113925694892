"""Operators of a training-data pipeline: cleaning, near duplicates, search, mixing and packing of documents."""
