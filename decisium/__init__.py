"""Typed-decision and corpus engine on PySpark DataFrames."""
