"""Speech-recording analytics as Spark tables, windows and streams."""
