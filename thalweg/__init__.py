"""Profile segmentation on Spark: keyed DataFrames in, stable segments out."""
