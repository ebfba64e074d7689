"""Column functions: fingerprints, percentiles and periods."""
