"""Operators on panels: DataFrame to DataFrame."""
