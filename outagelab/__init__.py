"""Outage cohort studies as PySpark DataFrame operators."""
