"""Security-telemetry analytics on Spark: normalise, detect, correlate, narrate, report."""
