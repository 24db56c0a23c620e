"""Versioned key-value state on Spark: ordered mutations in, last-writer-wins state out."""
