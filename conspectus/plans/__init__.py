"""Queries over the tables, with their SQL."""
