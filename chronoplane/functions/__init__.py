"""Column builders: paths, IEEE arithmetic, aggregates."""
