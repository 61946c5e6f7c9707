"""Column functions over text and times, and the few Arrow helpers Spark has no built-in for."""
