"""Batch and incremental jobs over auction and property data on Spark."""
