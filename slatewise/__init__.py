"""slatewise: media lineage on Spark DataFrames."""
