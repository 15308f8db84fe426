"""Batch analytics for municipal property data, written as Spark DataFrame jobs."""
