"""Numerical solvers, free of Spark."""
