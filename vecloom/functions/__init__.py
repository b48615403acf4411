"""Column functions on vectors, and their numpy twins for Arrow kernels."""
