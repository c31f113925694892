"""Relational building blocks that plain DataFrame calls do not cover in one step."""
