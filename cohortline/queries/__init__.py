"""Registered queries over the tables, with their SQL."""
