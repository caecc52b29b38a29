"""Cross-sectional signal analytics as PySpark DataFrame jobs."""
