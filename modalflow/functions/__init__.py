"""Column helpers and pure NumPy kernels."""
