"""Operators on DataFrames: gates, index values, corporate actions, metrics, validation and latest values."""
