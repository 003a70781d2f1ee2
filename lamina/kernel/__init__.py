"""Per-file kernels in plain Python, free of Spark."""
