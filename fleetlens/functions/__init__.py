"""Column expressions shared by the operators. None of them needs a Python worker."""
