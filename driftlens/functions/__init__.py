"""NumPy kernels for small dense arrays."""
