"""pagelathe: document analytics as Spark DataFrames."""
