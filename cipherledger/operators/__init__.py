"""Stages: each takes DataFrames and returns DataFrames."""
