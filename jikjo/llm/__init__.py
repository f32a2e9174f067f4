"""Operators for large training corpora: one module for each problem, and their queries."""
