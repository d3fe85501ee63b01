"""Column expressions and small in-task helpers shared by the operators."""
