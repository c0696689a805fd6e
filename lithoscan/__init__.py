"""Layout verification on Spark: design rules, netlists, electrical checks and parasitics as DataFrames."""
