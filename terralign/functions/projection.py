"""Inverse transverse Mercator by Krueger's series to order 6 (Karney 2011), as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

A, INVERSE_FLATTENING, K0 = 6378137.0, 298.257223563, 0.9996  # WGS 84 and the UTM scale


def _series(n: float) -> tuple[float, list[float]]:
    """Rectifying radius and the coefficients beta of the inverse series."""
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    beta = [
        n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3 - n**4 / 360 - 81 / 512 * n**5 + 96199 / 604800 * n**6,
        n**2 / 48 + n**3 / 15 - 437 / 1440 * n**4 + 46 / 105 * n**5 - 1118711 / 3870720 * n**6,
        17 / 480 * n**3 - 37 / 840 * n**4 - 209 / 4480 * n**5 + 5569 / 90720 * n**6,
        4397 / 161280 * n**4 - 11 / 504 * n**5 - 830251 / 7257600 * n**6,
        4583 / 161280 * n**5 - 108847 / 3991680 * n**6,
        20648693 / 638668800 * n**6,
    ]
    return radius, beta


def utm_to_lonlat(easting: Column, northing: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """(longitude, latitude) in degrees, x first, to well under a millimetre within a zone."""
    f = 1 / INVERSE_FLATTENING
    n, e = f / (2 - f), math.sqrt(f * (2 - f))
    radius, beta = _series(n)
    xi0 = (northing - (10_000_000.0 if south else 0.0)) / (K0 * radius)
    eta0 = (easting - 500_000.0) / (K0 * radius)
    xi, eta = xi0, eta0
    for j, b in enumerate(beta, 1):
        xi = xi - F.lit(b) * F.sin(xi0 * (2 * j)) * F.cosh(eta0 * (2 * j))
        eta = eta - F.lit(b) * F.cos(xi0 * (2 * j)) * F.sinh(eta0 * (2 * j))
    conformal = F.sin(xi) / F.sqrt(F.sinh(eta) ** 2 + F.cos(xi) ** 2)

    def newton(tau: Column, _: Column) -> Column:
        sigma = F.sinh(F.lit(e) * F.atanh(F.lit(e) * tau / F.sqrt(1 + tau * tau)))
        guess = tau * F.sqrt(1 + sigma * sigma) - sigma * F.sqrt(1 + tau * tau)
        return tau + (conformal - guess) / F.sqrt(1 + guess * guess) * (1 + (1 - e * e) * tau * tau) / ((1 - e * e) * F.sqrt(1 + tau * tau))

    tau = F.aggregate(F.sequence(F.lit(1), F.lit(5)), conformal, newton)
    return F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + (6 * zone - 183), F.degrees(F.atan(tau))


def checked_crs(source: str, target: str, expected: tuple[str, str]) -> None:
    """Both systems must be those of the contract."""
    if (source, target) != tuple(expected):
        raise ValueError(f"expected {expected}, got {(source, target)}")
