"""All registered queries and their checking SQL."""

from landsift.catalog import districts, geometry, learning, rasters, results, samples
from landsift.catalog.base import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES", "districts", "geometry", "learning", "rasters", "results", "samples"]
