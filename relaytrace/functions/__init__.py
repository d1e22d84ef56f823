"""Column-level building blocks (all JVM-side built-ins unless noted)."""
