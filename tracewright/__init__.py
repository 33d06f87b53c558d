"""Agent telemetry analytics on Spark DataFrames: batch operators, streaming jobs and SQL functions."""
