"""Layers and marts: compositions of column functions and operators."""
