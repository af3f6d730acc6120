"""Lodestack: analytics over binary archives, tables and text, on Spark."""
