"""Lodestar: a knowledge-graph analytics engine expressed in Spark DataFrames."""
