"""Registered queries: reads derived from the driver's tables, and their SQL twins."""
