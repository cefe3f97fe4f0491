"""Sources and sinks beyond the ones Spark has."""
