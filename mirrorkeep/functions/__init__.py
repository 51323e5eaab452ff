"""Column builders: plain expressions, no Python UDF."""
