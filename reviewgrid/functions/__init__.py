"""Column expressions (JVM-side built-ins only; no Python UDFs)."""
