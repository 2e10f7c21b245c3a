"""Spatial, raster, graph, time-series and data-quality analytics as Spark jobs."""
