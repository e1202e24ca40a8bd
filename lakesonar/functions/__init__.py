"""Column-expression helpers (all JVM-side built-ins)."""
