"""All queries of the library itself."""

from __future__ import annotations

from . import algebra, frames, geometry, grids, images, more
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "algebra", "frames", "geometry", "grids", "images", "more"]
