"""Incremental upkeep of statistics, pyramids, lines and requests as streams."""
