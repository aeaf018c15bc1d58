"""Column expressions: scalar, text and vector functions built from Spark built-ins."""
