"""Column expressions: tolerant casts, guarded aggregates, safe ratios, time helpers."""
