"""Pixel tables (row, col, value) sampled and summarised by joins.

A grid is described by west and north edges and pixel size: col = floor((lon - west) / size),
row = floor((north - lat) / size).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import haversine_km
from .polygons import edges, scan_spans, spans_of_pixels
from .relational import ContractError
from .spatial import containing


@dataclass(frozen=True)
class Grid:
    west: float
    north: float
    size: float
    nodata: float | None = None


def pixel_of(grid: Grid, lat: Column, lon: Column) -> tuple[Column, Column]:
    return F.floor((F.lit(grid.north) - lat) / grid.size).cast("long"), F.floor((lon - grid.west) / grid.size).cast("long")


def pixel_centre(grid: Grid, row: Column, col: Column) -> tuple[Column, Column]:
    return grid.north - (row + 0.5) * grid.size, grid.west + (col + 0.5) * grid.size


def valid(grid: Grid, value: Column) -> Column:
    return value if grid.nodata is None else F.when(F.abs(value - grid.nodata) > 1e-6, value)


def lookup(points: DataFrame, pixels: DataFrame, grid: Grid, *, lat: str = "lat", lon: str = "lon", name: str = "value") -> DataFrame:
    """points with row, col and the raw value of their pixel; NULL outside the raster."""
    row, col = pixel_of(grid, F.col(lat), F.col(lon))
    return points.withColumns({"row": row, "col": col}).join(pixels.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("value").alias(name)), ["row", "col"], "left")


def sample(points: DataFrame, pixels: DataFrame, grid: Grid, **names: str) -> DataFrame:
    """lookup() with nodata as NULL and the distance to the pixel's centre."""
    found = lookup(points, pixels, grid, **names)
    name, lat, lon = names.get("name", "value"), names.get("lat", "lat"), names.get("lon", "lon")
    clat, clon = pixel_centre(grid, F.col("row"), F.col("col"))
    return found.withColumns({name: valid(grid, F.col(name)), "centre_km": haversine_km(F.col(lat), F.col(lon), clat, clon)})


def neighbours(points: DataFrame, pixels: DataFrame, grid: Grid, keys: Sequence[str], *, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(keys, dr, dc, value) for the nine pixels around each point."""
    row, col = pixel_of(grid, F.col(lat), F.col(lon))
    offsets = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r in (-1, 0, 1) for c in (-1, 0, 1)])
    nine = points.select(*keys, row.alias("_r"), col.alias("_c"), F.explode(offsets).alias("o")).select(*keys, "o.dr", "o.dc", (F.col("_r") + F.col("o.dr")).alias("row"), (F.col("_c") + F.col("o.dc")).alias("col"))
    right = pixels.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), valid(grid, F.col("value")).alias("value"))
    return nine.join(right, ["row", "col"], "left").select(*keys, "dr", "dc", "value")


def focal_stats(points: DataFrame, pixels: DataFrame, grid: Grid, keys: Sequence[str], **names: str) -> DataFrame:
    """Mean, population deviation and range over nine pixels, missing ones left out."""
    return neighbours(points, pixels, grid, keys, **names).groupBy(*keys).agg(F.avg("value").alias("focal_mean"), F.stddev_pop("value").alias("focal_std"), (F.max("value") - F.min("value")).alias("focal_range"), F.count("value").alias("focal_n"))


def terrain(points: DataFrame, pixels: DataFrame, grid: Grid, keys: Sequence[str], *, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(keys, elevation, slope_deg, relief): slope from east-west and north-south differences in metres, relief over nine pixels."""
    at = lambda r, c: F.max(F.when((F.col("dr") == r) & (F.col("dc") == c), F.col("value")))
    flat = neighbours(points, pixels, grid, keys, lat=lat, lon=lon).groupBy(*keys).agg(at(0, 0).alias("elevation"), at(0, 1).alias("e"), at(0, -1).alias("w"), at(-1, 0).alias("n"), at(1, 0).alias("s"), (F.max("value") - F.min("value")).alias("relief"))
    metres = 111320.0 * grid.size
    j = flat.join(points.select(*keys, lat), list(keys))
    dx = (F.col("e") - F.col("w")) / (2 * metres * F.greatest(F.cos(F.radians(lat)), F.lit(0.01)))
    dy = (F.col("n") - F.col("s")) / (2 * metres)
    return j.select(*keys, "elevation", F.degrees(F.atan(F.sqrt(dx * dx + dy * dy))).alias("slope_deg"), "relief")


def rasterize(polygons: DataFrame, poly: str, grid: Grid) -> DataFrame:
    """(poly, part, row, first, last): runs of pixels whose centres a polygon holds, by scan lines."""
    return scan_spans(edges(polygons, poly), poly, west=grid.west, north=grid.north, size=grid.size)


def zonal_sum(pixels: DataFrame, grid: Grid, polygons: DataFrame, poly: str) -> DataFrame:
    """(poly, total): rounded sum of valid pixels whose centre a zone holds (the smallest key, if several); 0 when none."""
    valued = pixels.select("row", "col", valid(grid, F.col("value")).alias("value"))
    zone = spans_of_pixels(valued, rasterize(polygons, poly, grid), poly).groupBy("row", "col").agg(F.min(poly).alias(poly), F.first("value").alias("value"))
    sums = zone.groupBy(poly).agg(F.round(F.sum("value")).cast("long").alias("total"))
    return polygons.select(poly).distinct().join(sums, poly, "left").select(poly, F.coalesce("total", F.lit(0)).alias("total"))


def assert_aligned(transforms: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """transforms (raster_id, west, north, size), or ContractError if they are not the same within tolerance."""
    spread = transforms.agg(*[(F.max(c) - F.min(c)).alias(c) for c in ("west", "north", "size")]).first()
    if any(v is not None and v > tolerance for v in spread):
        raise ContractError(f"rasters are not aligned: {spread}")
    return transforms


def multi_layer_sample(points: DataFrame, layers: DataFrame, grid: Grid, keys: Sequence[str], names: Sequence[str], divisors: Mapping[str, float], **where: str) -> DataFrame:
    """points' keys with one column for each layer, scaled by its divisor: one join with the long table (layer, row, col, value), then a pivot."""
    row, col = pixel_of(grid, F.col(where.get("lat", "lat")), F.col(where.get("lon", "lon")))
    j = points.select(*keys, row.alias("row"), col.alias("col")).join(layers, ["row", "col"], "left")
    return j.groupBy(*keys).agg(*[F.max(F.when(F.col("layer") == n, valid(grid, F.col("value")) / divisors.get(n, 1.0))).alias(n) for n in names])


def rasterize_lookup(points: DataFrame, polygons: DataFrame, poly: str, areas: DataFrame, grid: Grid, keys: Sequence[str], *, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """points with the polygon of their pixel's centre; the smallest polygon (drawn last) wins."""
    row, col = pixel_of(grid, F.col(lat), F.col(lon))
    placed = points.withColumns({"_row": row, "_col": col})
    drawn = spans_of_pixels(placed.select("_row", "_col").distinct(), rasterize(polygons, poly, grid), poly, row="_row", col="_col")
    found = drawn.join(areas, poly).groupBy("_row", "_col").agg(F.min_by(poly, F.struct("area_ha", poly)).alias(poly))
    return placed.join(found, ["_row", "_col"], "left").select(*points.columns, poly)


def code_label(df: DataFrame, code: str, labels: DataFrame, native: Sequence[int], ambiguous: Sequence[int]) -> DataFrame:
    """df with label, is_native and is_ambiguous of its source code. labels: (code, label)."""
    c = F.col(code)
    return df.join(labels.select(F.col("code").alias(code), "label"), code, "left").withColumns({"label": F.when(c.isNull(), "Missing source code").otherwise(F.coalesce("label", F.lit("Unknown source code"))), "is_native": F.coalesce(c.isin(*native), F.lit(False)), "is_ambiguous": F.coalesce(c.isin(*ambiguous), F.lit(True))})


def scene_coverage(footprints: DataFrame, scene: str, points: DataFrame, key: str) -> DataFrame:
    """(scene, n_points): centroids inside each footprint (vertex table)."""
    found = containing(points, edges(footprints, scene), [key], scene).groupBy(scene).agg(F.count("*").alias("n_points"))
    return footprints.select(scene).distinct().join(found, scene, "left").fillna(0, ["n_points"])


def radiometric_scale(obs: DataFrame, constants: DataFrame, keys: Sequence[str], dn: str = "dn") -> DataFrame:
    """obs with reflectance = (DN + offset) / quantification of its scene and band; DN 0 is missing."""
    return obs.join(constants, list(keys), "left").withColumn("reflectance", F.when(F.col(dn) != 0, (F.col(dn) + F.col("offset")) / F.col("quantification")))


def scene_manifest(selected: DataFrame, stats: DataFrame, scene: str, struct: str) -> DataFrame:
    """One row a scene: its properties flattened, with its extraction statistics."""
    return selected.select(scene, f"{struct}.*").join(stats, scene, "left")


def scene_ids_by_cell(points: DataFrame, cell: str, scene: str) -> DataFrame:
    return points.groupBy(cell).agg(F.sort_array(F.collect_set(scene)).alias("scene_ids"))
