"""Column-level building blocks: array arithmetic, smoothing kernels, physics."""
