"""Column -> Column helpers. No Python runs per row."""
