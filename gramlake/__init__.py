"""Indexed regular-expression search over large text collections, on Spark DataFrames."""
