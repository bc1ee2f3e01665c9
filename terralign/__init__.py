"""Raster / point-cloud matching and run-report analytics as PySpark DataFrame operators."""
