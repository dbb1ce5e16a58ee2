"""Structuring pages into ordered blocks, tables and conversion-job relations with PySpark."""
