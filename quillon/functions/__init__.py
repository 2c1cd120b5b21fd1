"""Kinds of values, conversions, scalar functions and dates, as Spark SQL expressions."""
