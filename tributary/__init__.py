"""Versioned-table analytics on Spark: folds, branches, time travel and merges as DataFrames."""
