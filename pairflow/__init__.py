"""pairflow: Spark operators for pairwise measurement tables.

A pairwise table has one row per observation of two entities under a condition
(for example a mixture at a composition and temperature) and one or more numeric
targets.  Every operator takes DataFrames and returns a DataFrame.
"""
