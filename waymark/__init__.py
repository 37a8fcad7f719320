"""waymark: spatio-temporal feature analytics as PySpark DataFrame jobs."""
