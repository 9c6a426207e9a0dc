"""Keyword-set search analytics, expressed as Spark DataFrame jobs."""
