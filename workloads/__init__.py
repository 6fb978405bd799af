"""Queries over the driver tables, each with its plain SQL where SQL can express it."""
