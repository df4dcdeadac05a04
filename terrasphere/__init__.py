"""Planetary raster and vector analytics as Spark DataFrame jobs."""

EARTH_RADIUS = 6371000.0
TILE_RESOLUTION = 65
MAX_LEVEL = 23
