"""Metrics, resampling, rank statistics and pair kernels."""
