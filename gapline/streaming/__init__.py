"""Structured Streaming: tumbling and session windows, the rise rule with state, forecasts that are only ever appended."""
