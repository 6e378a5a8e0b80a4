"""Column expressions and skew-safe group primitives."""
