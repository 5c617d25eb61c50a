"""Typed plans: model, static check, compilation to DataFrames."""
