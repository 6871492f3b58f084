"""gapline: gap-aware time-series and event analytics on PySpark."""
