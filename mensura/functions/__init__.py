"""Column → Column expressions."""
