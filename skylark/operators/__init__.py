"""Joins, graphs and engines over signal-shaped DataFrames."""
