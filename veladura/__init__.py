"""Synthetic tables and personal-data masking as Spark DataFrame jobs."""
