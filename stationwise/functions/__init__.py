"""Column expressions (calendar, geography, statistics) and distributed ranks."""
