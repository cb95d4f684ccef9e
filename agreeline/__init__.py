"""Cohort gaps, agreement and robust statistics over clustered fact tables, as Spark jobs."""
