"""Catalogue search and data-quality engine on PySpark."""
