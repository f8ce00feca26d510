"""cellgrove: raster and experiment analytics as Spark DataFrame operators."""
