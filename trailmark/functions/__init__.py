"""Column functions: each takes and returns Spark columns and runs inside the JVM unless noted."""
