"""Label-quality and annotation operators over Spark DataFrames."""
