"""Column expressions that stay inside code generation."""
