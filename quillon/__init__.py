"""Quillon: review-evidence analytics and corpus preparation as Spark DataFrame jobs."""
