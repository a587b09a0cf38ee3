"""Column functions: time zones, text, sections, rounding."""
