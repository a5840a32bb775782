"""Column expressions: no joins, no shuffles, everything inside codegen."""
