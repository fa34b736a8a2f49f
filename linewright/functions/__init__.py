"""Column-level building blocks: plain Spark expressions, no Python UDFs."""
