"""Operators on DataFrames: each takes and gives frames and leaves the plan to Catalyst."""
