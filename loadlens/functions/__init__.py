"""Column expressions and building blocks shared by the operators."""
