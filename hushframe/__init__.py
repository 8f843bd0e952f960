"""hushframe: personal-data detection, policy and reversible tokens on Spark.

Everything is a plain function from DataFrame (or Column) to DataFrame (or
Column); settings are passed in, never kept in module state.
"""
