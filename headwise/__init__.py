"""headwise: bus telemetry analytics as plain Spark DataFrame functions."""
