"""Parameters that every stage of a scene shares."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Contract:
    """Raster, window and sampling parameters. Band numbers count from 0.

    The defaults are fixed values that results depend on.
    """

    bands: int = 342
    red: int = 143
    nir: int = 262
    ndvi_threshold: float = 0.2
    nodata_epsilon: float = 1e-5
    patch: int = 3
    neighbours: int = 15
    radius: int = 5
    sample: int = 1000
    seed: int = 20260617
    source_crs: str = "EPSG:32651"
    target_crs: str = "EPSG:4326"
