"""Column functions: vectors, rasters, projection, text."""
