"""Relational operators Spark does not ship as one call."""
