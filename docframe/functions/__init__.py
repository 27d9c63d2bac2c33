"""Column functions: formats, text, sheets, counters."""
