"""Cohort, tensor and latent-pattern operators on Spark DataFrames."""
