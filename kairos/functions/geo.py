"""Geographic → projected coordinates as Column math."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# EPSG:2263, NAD83 / New York Long Island (US survey feet),
# Lambert conformal conic with two standard parallels on the GRS80 ellipsoid.
LCC_NY_LONG_ISLAND = {
    "lat1": 41.0 + 2.0 / 60.0, "lat2": 40.0 + 40.0 / 60.0, "lat0": 40.0 + 10.0 / 60.0, "lon0": -74.0,
    "x0_m": 300000.0, "y0_m": 0.0, "a": 6378137.0, "inv_f": 298.257222101, "unit_m": 1200.0 / 3937.0,
}


def _consts(p: dict):
    a = p["a"]
    f = 1.0 / p["inv_f"]
    e = math.sqrt(2 * f - f * f)

    def m(phi):
        return math.cos(phi) / math.sqrt(1 - (e * math.sin(phi)) ** 2)

    def t(phi):
        s = math.sin(phi)
        return math.tan(math.pi / 4 - phi / 2) / ((1 - e * s) / (1 + e * s)) ** (e / 2)

    p1, p2, p0 = (math.radians(p[k]) for k in ("lat1", "lat2", "lat0"))
    n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    Fc = m(p1) / (n * t(p1) ** n)
    rho0 = a * Fc * t(p0) ** n
    return a, e, n, Fc, rho0


def lambert_conformal(lon: str | Column, lat: str | Column, params: dict = LCC_NY_LONG_ISLAND) -> dict[str, Column]:
    """(lon, lat) degrees → (x, y) in the projection's unit (feet for EPSG:2263)."""
    a, e, n, Fc, rho0 = _consts(params)
    lo = F.col(lon) if isinstance(lon, str) else lon
    la = F.col(lat) if isinstance(lat, str) else lat
    phi = F.radians(la)
    s = F.sin(phi)
    t = F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((F.lit(1.0) - s * e) / (F.lit(1.0) + s * e), F.lit(e / 2))
    rho = F.lit(a * Fc) * F.pow(t, F.lit(n))
    theta = F.lit(n) * F.radians(lo - F.lit(params["lon0"]))
    u = params["unit_m"]
    x = (F.lit(params["x0_m"]) + rho * F.sin(theta)) / F.lit(u)
    y = (F.lit(params["y0_m"]) + F.lit(rho0) - rho * F.cos(theta)) / F.lit(u)
    return {"x": x, "y": y}
