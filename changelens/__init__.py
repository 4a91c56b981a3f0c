"""Change analytics on Spark: code graphs, diagnostics and verification as DataFrames."""
