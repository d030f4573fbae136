"""Preference data for text-quality models as Spark DataFrame jobs."""
