"""Column functions and NumPy kernels."""
