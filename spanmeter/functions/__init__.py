"""Column expressions and keyed helpers every operator is built from."""
