"""Queries that bind the operators to the driver's tables."""
