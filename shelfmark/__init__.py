"""Retail analytics marts and corpus operators, written for PySpark."""
