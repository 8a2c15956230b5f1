"""Column expressions of the map algebra.  NULL is the only missing value and always stays NULL."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lower bounds and labels of the risk ladders, lowest first.
LADDERS = {
    "api": [("Safe", None), ("Moderate", 0.10), ("High", 0.25), ("Critical", 0.50)],
    "dashboard": [("Safe", None), ("Moderate", 0.12), ("High", 0.20), ("Critical", 0.30)],
    "csv": [("Safe", None), ("Moderate", 0.10), ("High", 0.20), ("Critical", 0.30)],
    "legend": [("<10", None), ("10-20", 0.10), ("20-35", 0.20), ("35-50", 0.35), (">50", 0.50)],
}
#: The ladder of known spots has strict bounds.
STRICT_LADDERS = {"hotspot": [("Low", None), ("Medium", 0.4), ("High", 0.7)]}

#: Colours of probability knots, piecewise linear between them.
KNOTS = [(0.00, (26, 152, 80)), (0.10, (145, 207, 96)), (0.20, (254, 224, 139)), (0.35, (253, 174, 97)), (0.55, (215, 48, 39)), (1.00, (165, 0, 38))]


def to_null(x: Column, below: float | None = None, equals: float | None = None, at_most: float | None = None) -> Column:
    """Nodata rules of a raster as NULL: NaN, then a sentinel bound, a sentinel value, or codes up to a limit."""
    bad = F.isnan(x)
    if below is not None:
        bad = bad | (x < below)
    if equals is not None:
        bad = bad | (x == equals)
    if at_most is not None:
        bad = bad | (x <= at_most)
    return F.when(~bad, x)


def clip(x: Column, lo: float, hi: float) -> Column:
    """least and greatest skip NULL, so the NULL is kept by hand."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def ratio(a: Column, b: Column, other: float = 0.0) -> Column:
    """a / b, or `other` where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(other))


def difference_index(a: Column, b: Column) -> Column:
    """(a - b) / (a + b): NDWI of green and infrared, NDVI of infrared and red; NULL where the sum is 0."""
    return F.try_divide(a - b, a + b)


def inverse_slope(slope: Column) -> Column:
    return clip(1 - F.coalesce(slope, F.lit(90.0)) / 90, 0.0, 1.0)


def inverse_hand(hand: Column) -> Column:
    return 1 - clip(F.coalesce(hand, F.lit(20.0)), 0.0, 20.0) / 20


def urban_risk(distance: Column) -> Column:
    return clip(1 - F.coalesce(distance, F.lit(5000.0)) / 2000, 0.0, 1.0)


def ndwi_scale(ndwi: Column) -> Column:
    return clip((F.coalesce(ndwi, F.lit(-1.0)) + 1) / 2, 0.0, 1.0)


def log_flow(flow: Column) -> Column:
    return F.log1p(F.greatest(F.coalesce(flow, F.lit(0.0)), F.lit(0.0)))


def contributing_area(flow: Column, mean_flow: Column, cell: float = 30.0) -> Column:
    """Flow accumulation of small mean is taken as a logarithm."""
    return F.when(mean_flow < 15, F.exp(flow)).otherwise(flow) * cell


def slope_radians(slope: Column) -> Column:
    return F.radians(F.when(slope.isNotNull(), F.greatest(slope, F.lit(0.1))))


def wetness(area: Column, rad: Column, clipped: bool = False, dry: float | None = None) -> Column:
    """dry: the index where nothing flows, NULL unless given (Spark's ln has no value at 0)."""
    x = area / (F.tan(rad) + 1e-6)
    twi = F.ln(x) if dry is None else F.when(x == 0, F.lit(dry)).otherwise(F.ln(x))
    return clip(twi, 0.0, 20.0) if clipped else twi


def stream_power(area: Column, rad: Column) -> Column:
    return F.log1p(area * F.tan(rad))


def sediment_transport(area: Column, rad: Column) -> Column:
    return F.log1p(F.pow(area / 22.13, F.lit(0.6)) * F.pow(F.sin(rad) / 0.0896, F.lit(1.3)))


def water_mask(lulc: Column, dem: Column) -> Column:
    """Water codes of the decade land-cover table, no elevation, or elevation below half a metre."""
    return lulc.isin(80, 90, 95) | dem.isNull() | F.coalesce(dem < 0.5, F.lit(False))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a * (1 - t) + b * t


def rainfall_interpolation(r: Column, m100: Column, m150: Column, m200: Column) -> Column:
    """Risk at a rainfall between the mapped scenarios, r held to 0..200."""
    r = clip(r, 0.0, 200.0)
    return F.when(r <= 100, m100 * r / 100).when(r <= 150, lerp(m100, m150, (r - 100) / 50)).otherwise(lerp(m150, m200, (r - 150) / 50))


def hydro_boost(data: Column, hydro: Column, r: Column) -> Column:
    return clip(data + F.coalesce(hydro, F.lit(0.0)) * F.least(r / 200, F.lit(1.0)) * 0.2, 0.0, 1.0)


def physical_risk(hydro: Column, r: Column) -> Column:
    return F.coalesce(hydro, F.lit(0.0)) * (r / 200) * 1.2


def hybrid_risk(data: Column, hydro: Column, r: Column) -> Column:
    """The larger of the mapped and the physical risk; NULL where there is no map."""
    return F.when(data.isNotNull(), clip(F.greatest(data, physical_risk(hydro, r)), 0.0, 1.0))


def ladder(x: Column, name: str) -> Column:
    """The class of x: the last one whose lower bound it reaches (exceeds, for strict ladders)."""
    strict = name in STRICT_LADDERS
    steps = (STRICT_LADDERS if strict else LADDERS)[name]
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for label, bound in reversed(steps[1:]):
        out = out.when(x > bound if strict else x >= bound, F.lit(label))
    return out.otherwise(F.lit(steps[0][0]))


def colormap(p: Column) -> list[Column]:
    """r, g, b, a of a probability; transparent outside 0..1.  At a knot the later segment wins."""
    inside = p.between(0.0, 1.0)
    channels = []
    for k, name in enumerate("rgb"):
        out = F.when(~inside | p.isNull(), F.lit(0))
        for (v0, c0), (v1, c1) in reversed(list(zip(KNOTS, KNOTS[1:]))):
            t = (p - v0) / (v1 - v0 + 1e-6)
            out = out.when(p >= v0, F.floor(c0[k] * (1 - t) + c1[k] * t).cast("int"))
        channels.append(out.alias(name))
    return [*channels, F.when(inside, 200).otherwise(0).alias("a")]


def nearest_scenario(mm: Column, scenarios: tuple[int, ...] = (100, 150, 200)) -> Column:
    """The mapped scenario next to mm, the lower one of two."""
    each = F.array(*[F.struct(F.abs(mm - s).alias("d"), F.lit(s).alias("s")) for s in scenarios])
    return F.array_min(each)["s"]


# ---- places on the earth: closed Krueger series between longitude/latitude and UTM

#: The WGS 84 ellipsoid and the UTM grid.
_A, _F, _K0, _E0 = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0
_N = _F / (2 - _F)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def to_utm(lon: Column, lat: Column, meridian: float = 75.0) -> tuple[Column, Column]:
    """Easting and northing (northern hemisphere) of degrees."""
    e = 2 * math.sqrt(_N) / (1 + _N)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    d = F.radians(lon - meridian)
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return _E0 + _K0 * _RADIUS * x, _K0 * _RADIUS * y


def from_utm(easting: Column, northing: Column, meridian: float = 75.0) -> tuple[Column, Column]:
    """Longitude and latitude in degrees."""
    xi, eta = northing / (_K0 * _RADIUS), (easting - _E0) / (_K0 * _RADIUS)
    x, y = eta, xi
    for j, b in enumerate(_BETA, 1):
        x = x - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    chi = F.asin(F.sin(y) / F.cosh(x))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return meridian + F.degrees(F.atan2(F.sinh(x), F.cos(y))), F.degrees(lat)


def cell_of(x: Column, y: Column, transform: tuple[float, float, float, float, float, float]) -> tuple[Column, Column]:
    """Row and column of map coordinates; transform (a, b, c, d, e, f): x = a col + b row + c, y = d col + e row + f."""
    a, b, c, d, e, f = transform
    det = a * e - b * d
    col, row = (e * (x - c) - b * (y - f)) / det, (a * (y - f) - d * (x - c)) / det
    return F.floor(row).cast("int"), F.floor(col).cast("int")


def corner_of(row: Column, col: Column, transform: tuple[float, float, float, float, float, float]) -> tuple[Column, Column]:
    """Map coordinates of a cell's corner."""
    a, b, c, d, e, f = transform
    return a * col + b * row + c, d * col + e * row + f
