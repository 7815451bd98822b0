"""Commercial-operations analytics as PySpark DataFrame functions."""
