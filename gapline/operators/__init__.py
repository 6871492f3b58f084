"""Operators on series and events: DataFrame to DataFrame, declarative, safe for long series."""
