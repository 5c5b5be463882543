"""Code-graph analytics on Spark: symbols, edges, text search, change tracking and run reports as DataFrame plans."""

__version__ = "0.1.0"
