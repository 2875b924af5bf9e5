"""Paragraph-level review of prose on Spark, and operators for preparing training text."""
