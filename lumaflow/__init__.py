"""Spark-native analytics over raster images: pixels are rows, nodes are DataFrame transformations."""
