"""Column expressions (JVM built-ins only)."""
