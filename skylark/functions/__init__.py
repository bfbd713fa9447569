"""Column kernels: no UDF unless a sequence of characters has to be aligned."""
