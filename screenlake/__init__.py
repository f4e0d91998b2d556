"""Eligibility screening and training-data operators as Spark DataFrame jobs."""
