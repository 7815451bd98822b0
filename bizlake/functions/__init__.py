"""Column-level helpers; every one returns native expressions."""
