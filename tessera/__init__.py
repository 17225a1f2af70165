"""Evidence selection analytics on Spark: sources, functions, operators, plans, streaming."""

__version__ = "0.1.0"
