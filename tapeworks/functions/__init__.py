"""Column-level building blocks (no shuffles)."""
