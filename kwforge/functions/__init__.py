"""Keyword-set search analytics on Spark: functions."""
