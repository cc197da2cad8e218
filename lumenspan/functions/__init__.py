"""Column expressions: text, locations and intervals, statistics."""
