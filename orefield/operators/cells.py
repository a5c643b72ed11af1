"""Hierarchical equal-angle grid cells.

A cell id is res << 56 plus the interleaved column and row numbers, so a parent is a shift. Cells of resolution
r are 180 / 2^r degrees wide and high; resolutions go up to 15.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import EARTH_RADIUS_KM

HIGHEST = 15
#: Masks that spread 16 bits to the even places of 32.
_SPREAD = ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555))


def _spread(x: Column) -> Column:
    for shift, mask in _SPREAD:
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def _compact(x: Column) -> Column:
    x = x.bitwiseAND(F.lit(0x55555555))
    for shift, mask in ((1, 0x33333333), (2, 0x0F0F0F0F), (4, 0x00FF00FF), (8, 0x0000FFFF)):
        x = x.bitwiseOR(F.shiftright(x, shift)).bitwiseAND(F.lit(mask))
    return x


def degrees(res: int) -> float:
    return 180.0 / (1 << res)


def cell_of(lat: Column, lon: Column, res: int) -> Column:
    """Cell id of a point; NULL outside the globe. The north pole and the antimeridian's east side belong to the last row and first column."""
    row = F.least(F.floor((lat + 90) / degrees(res)), F.lit((1 << res) - 1)).cast("long")
    column = F.pmod(F.floor((lon + 180) / degrees(res)), F.lit(2 << res)).cast("long")
    inside = lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(inside, F.lit(res << 56) + _spread(column) + 2 * _spread(row))


def resolution(cell: Column) -> Column:
    return F.shiftright(cell, 56)


def _place(cell: Column) -> Column:
    return cell.bitwiseAND(F.lit((1 << 56) - 1))


def valid_cell(cell: Column, res: int) -> Column:
    """Well formed and of that resolution."""
    place = _place(cell)
    return (resolution(cell) == res) & (_compact(place) < (2 << res)) & (_compact(F.shiftright(place, 1)) < (1 << res)) & (place < F.lit(1 << 32))


def parent(cell: Column, res: int, to: int) -> Column:
    return F.lit(to << 56) + F.shiftright(_place(cell), 2 * (res - to))


def children(cell: Column, res: int, to: int) -> Column:
    """Array of the 4^(to - res) descendants."""
    n = 1 << (2 * (to - res))
    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), lambda i: F.lit(to << 56) + F.shiftleft(_place(cell), 2 * (to - res)) + i)


def centre(cell: Column, res: int) -> tuple[Column, Column]:
    """(lat, lon)."""
    d = degrees(res)
    return (_compact(F.shiftright(_place(cell), 1)) + 0.5) * d - 90, (_compact(_place(cell)) + 0.5) * d - 180


def geometry(cell: Column, res: int) -> tuple[Column, Column]:
    """(boundary WKT, area in square km): area varies with latitude."""
    lat, lon = centre(cell, res)
    h = degrees(res) / 2
    corner = lambda dx, dy: F.format_string("%.6f %.6f", lon + dx, lat + dy)
    wkt = F.concat(F.lit("POLYGON (("), F.concat_ws(", ", corner(-h, -h), corner(h, -h), corner(h, h), corner(-h, h), corner(-h, -h)), F.lit("))"))
    area = EARTH_RADIUS_KM**2 * F.radians(F.lit(2 * h)) * (F.sin(F.radians(lat + h)) - F.sin(F.radians(lat - h)))
    return wkt, area


def sample_points(cells: DataFrame, cell_col: str, res: int, to: int) -> DataFrame:
    """One row for each child centre, numbered in id order."""
    out = cells.select("*", F.posexplode(children(F.col(cell_col), res, to)).alias("sample", "child"))
    lat, lon = centre(F.col("child"), to)
    return out.withColumns({"sample_lat": lat, "sample_lon": lon})


def utm_to_wgs84(zone: Column, east: Column, north: Column, south: Column | None = None) -> tuple[Column, Column]:
    """(lat, lon) by the inverse series on the WGS84 ellipsoid; NULL outside plausible eastings and northings."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep = e2 / (1 - e2)
    n0 = F.when(south, north - 1e7).otherwise(north) if south is not None else north
    mu = n0 / k0 / (a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    e1 = (1 - (1 - e2) ** 0.5) / (1 + (1 - e2) ** 0.5)
    phi = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + (151 * e1**3 / 96) * F.sin(6 * mu) + (1097 * e1**4 / 512) * F.sin(8 * mu)
    s, c, t = F.sin(phi), F.cos(phi), F.tan(phi)
    c1, t1 = ep * c * c, t * t
    n1, r1 = a / F.sqrt(1 - e2 * s * s), a * (1 - e2) / F.pow(1 - e2 * s * s, 1.5)
    d = (east - 500000.0) / (n1 * k0)
    lat = phi - (n1 * t / r1) * (d * d / 2 - (5 + 3 * t1 + 10 * c1 - 4 * c1 * c1 - 9 * ep) * F.pow(d, 4) / 24 + (61 + 90 * t1 + 298 * c1 + 45 * t1 * t1 - 252 * ep - 3 * c1 * c1) * F.pow(d, 6) / 720)
    lon = (d - (1 + 2 * t1 + c1) * F.pow(d, 3) / 6 + (5 - 2 * c1 + 28 * t1 - 3 * c1 * c1 + 8 * ep + 24 * t1 * t1) * F.pow(d, 5) / 120) / c
    fits = east.between(100000, 900000) & north.between(0, 10000000)
    return F.when(fits, F.degrees(lat)), F.when(fits, F.degrees(lon) + zone * 6 - 183)
