"""Column-level helpers: report calendar and money expressions."""
