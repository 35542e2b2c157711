"""Column expressions (text, numbers, dates) shared by the operators."""
