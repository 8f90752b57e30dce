"""Queries over the driver's tables, each with SQL that tells the same."""
