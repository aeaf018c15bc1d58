"""The query catalogue: each entry pairs a Spark plan with equivalent SQL."""
