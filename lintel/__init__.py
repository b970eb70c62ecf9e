"""lintel: query workloads on Spark DataFrames — execute them, or analyse their text."""
