"""Operators for preparing training text, each a DataFrame-to-DataFrame function."""
