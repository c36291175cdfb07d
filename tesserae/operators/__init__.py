"""Relational and domain operators; every one takes and returns DataFrames."""
