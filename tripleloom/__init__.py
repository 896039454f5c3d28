"""Graph patterns, rules and statement-level data processing on Spark DataFrames."""
