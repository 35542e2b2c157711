"""Registered report queries over the driver tables, and their SQL oracles."""
