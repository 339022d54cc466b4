"""Column expressions and the shared building blocks for skew-safe plans."""
