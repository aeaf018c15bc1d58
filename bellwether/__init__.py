"""Event-study analytics over news and market tables, as Spark DataFrame operators."""

__version__ = "0.1.0"
