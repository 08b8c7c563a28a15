"""Queries over the driver's tables, with the SQL that states the same result."""
