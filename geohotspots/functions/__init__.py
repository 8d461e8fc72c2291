"""Column expressions: text, JSON arrays, timestamps, geometry."""
