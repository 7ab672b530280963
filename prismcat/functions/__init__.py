"""Column expressions (JVM side) and the small per-image numpy helpers."""
