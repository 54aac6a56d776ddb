"""Column expressions: no I/O, no Python workers."""
