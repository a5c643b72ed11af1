"""Sources and sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import row_hash
from ..operators.relational import ContractError


def scan(spark: SparkSession, path: str, columns: Sequence[str], predicate: str | None = None, *, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """Only the named columns and rows are read: both reach a Parquet scan."""
    reader = spark.read.format(fmt)
    if schema:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    df = reader.load(path)
    return (df.where(predicate) if predicate else df).select(*columns)


def scan_tiles(spark: SparkSession, glob: str, marker: str, schema: str, expected: int) -> DataFrame:
    """Rows of all tiles whose table starts after the marker line, with the tile's path; ContractError for another number of tiles.

    schema is DDL; the header line behind the marker must name its columns.
    """
    lines = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("tile"), F.col("value"))
    found = lines.select("tile").distinct().count()
    if found != expected:
        raise ContractError(f"{found} tiles, {expected} expected")
    body = lines.select("tile", F.substring("value", F.instr("value", marker) + len(marker), F.length("value")).alias("b"))
    rows = body.select("tile", F.posexplode(F.filter(F.split(F.trim(F.regexp_replace("b", "^[^\n]*\n", "")), "\r?\n"), lambda x: F.trim(x) != "")).alias("n", "line"))
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    wrong = rows.where(F.col("n") == 0).where(F.col("line") != ",".join(names)).limit(1).collect()
    if wrong:
        raise ContractError(f"missing column in {wrong[0].tile}: {wrong[0].line}")
    return rows.where(F.col("n") > 0).select("tile", F.from_csv("line", schema).alias("r")).select("tile", "r.*")


def scan_dimension_json(spark: SparkSession, path: str, schema: str, rank: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path).orderBy(rank)


def scan_features(collections: DataFrame, text: str, properties: str) -> tuple[DataFrame, DataFrame]:
    """(features, vertices) of feature-collection texts: one row a feature with its properties; all rings as (feature, part, ring, seq, x, y).

    Polygon and MultiPolygon geometries; ring 0 of a part is its outer one, the others are holes, which even-odd crossings of all
    rings leave out. The point that closes a ring is dropped; features without a ring of three points go.
    """
    shape = f"struct<features:array<struct<id:string,properties:struct<{properties}>,geometry:struct<type:string,coordinates:string>>>>"
    rings = "array<array<array<double>>>"
    each = collections.select(F.explode(F.from_json(text, shape)["features"]).alias("f")).where("f.geometry.type in ('Polygon', 'MultiPolygon')")
    body = F.col("f.geometry.coordinates")
    parts = F.when(F.col("f.geometry.type") == "Polygon", F.array(F.from_json(body, rings))).otherwise(F.from_json(body, f"array<{rings}>"))
    each = each.withColumn("parts", parts).where("exists(parts, p -> size(p[0]) > 3)")
    features = each.select(F.col("f.id").alias("feature"), "f.properties.*")
    part = each.select(F.col("f.id").alias("feature"), F.posexplode("parts").alias("part", "rings"))
    ring = part.select("feature", "part", F.posexplode("rings").alias("ring", "points")).where("size(points) > 3")
    point = ring.select("feature", "part", "ring", F.posexplode(F.expr("slice(points, 1, size(points) - 1)")).alias("seq", "p"))
    return features, point.select("feature", "part", "ring", "seq", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def scan_raster(pixels: DataFrame, rows: tuple[int, int], cols: tuple[int, int], padding: int = 1) -> DataFrame:
    """The window with padding; the ranges reach the scan."""
    return pixels.where(F.col("row").between(rows[0] - padding, rows[1] + padding) & F.col("col").between(cols[0] - padding, cols[1] + padding))


#: Logical types of a dictionary and the Spark types they become.
LOGICAL_TYPES = {"integer": "bigint", "number": "double", "boolean": "boolean", "text": "string", "JSON": "string"}


def typed_by_dictionary(df: DataFrame, dictionary: Mapping[str, str]) -> DataFrame:
    """Text columns as the dictionary's types; blank is NULL. The column sets must be equal."""
    if set(df.columns) != set(dictionary):
        raise ContractError(f"columns and dictionary differ: {sorted(set(df.columns) ^ set(dictionary))}")
    return df.select(*[F.nullif(F.trim(F.col(c)), F.lit("")).try_cast(LOGICAL_TYPES[dictionary[c]]).alias(c) for c in df.columns])


def as_text(df: DataFrame, columns: Sequence[str], digits: int) -> DataFrame:
    """Fixed column order, blank for NULL, fixed digits for doubles."""
    kinds = dict(df.dtypes)
    shown = [F.format_string(f"%.{digits}f", F.col(c)) if kinds[c] in ("double", "float") else F.col(c).cast("string") for c in columns]
    return df.select(*[F.coalesce(F.when(F.col(c).isNotNull(), s), F.lit("")).alias(c) for c, s in zip(columns, shown)])


def write_table(df: DataFrame, path: str, columns: Sequence[str], digits: int = 6, fmt: str = "csv") -> None:
    out = as_text(df, columns, digits) if fmt == "csv" else df.select(*columns)
    writer = out.write.format(fmt)
    (writer.option("header", True).option("emptyValue", "") if fmt == "csv" else writer).save(path)


def geojson_features(df: DataFrame, key: str, wkt: str, properties: Sequence[str]) -> DataFrame:
    """(feature): one JSON Feature a row, coordinates from the WKT of a polygon or multipolygon with any holes, a hash of its fields among the properties.

    Other geometry and missing WKT give a null geometry.
    """
    text = F.upper(F.trim(wkt))
    body = F.regexp_replace(F.trim(wkt), r"^[A-Za-z]+\s*\(+\s*|\s*\)+$", "")
    ring = lambda r: F.transform(F.split(F.trim(r), r"\s*,\s*"), lambda p: F.transform(F.split(F.trim(p), r"\s+"), lambda v: v.cast("double")))
    part = lambda t: F.transform(F.split(t, r"\)\s*,\s*\("), ring)
    parts = F.transform(F.split(body, r"\)\s*\)\s*,\s*\(\s*\("), part)
    shape = lambda kind, coordinates: F.to_json(F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")))
    geometry = F.when(text.startswith("POLYGON"), shape("Polygon", part(body))).when(text.startswith("MULTIPOLYGON"), shape("MultiPolygon", parts)).otherwise("null")
    props = F.to_json(F.struct(*[F.col(c) for c in properties], row_hash(*[F.col(c) for c in properties]).alias("row_sha256")), {"ignoreNullFields": "false"})
    head = F.to_json(F.struct(F.lit("Feature").alias("type"), F.col(key).cast("string").alias("id")))
    return df.select(F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"properties":'), props, F.lit(',"geometry":'), F.coalesce(geometry, F.lit("null")), F.lit("}")).alias("feature"))


def write_geojson(df: DataFrame, path: str, key: str, wkt: str, properties: Sequence[str]) -> None:
    """Newline-delimited features."""
    geojson_features(df, key, wkt, properties).write.text(path)


def upsert(target: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    return target.join(incoming.select(*keys), list(keys), "left_anti").unionByName(incoming)


def augment(base: DataFrame, features: DataFrame, key: str, managed: Sequence[str]) -> DataFrame:
    """base with the managed columns taken from features; running it again changes nothing. ContractError if a base key is missing."""
    lost = base.join(features.select(key), key, "left_anti").limit(1).collect()
    if lost:
        raise ContractError(f"no features for {lost[0][key]}")
    return base.drop(*managed).join(features.select(key, *managed), key, "left")


def project(df: DataFrame, mapping: Mapping[str, str], preferred: Sequence[str]) -> DataFrame:
    """Renamed columns, the preferred ones first, those that exist only."""
    named = df.withColumnsRenamed({a: b for a, b in mapping.items() if a in df.columns})
    return named.select(*[c for c in preferred if c in named.columns])


def within_bounds(df: DataFrame, lat: str, lon: str, box: tuple[float, float, float, float]) -> DataFrame:
    """All rows with in_bounds; box: south, north, west, east."""
    return df.withColumn("in_bounds", F.coalesce(F.col(lat).between(box[0], box[1]) & F.col(lon).between(box[2], box[3]), F.lit(False)))


def level_filter(df: DataFrame, level: Column, total: Column, keep_totals: bool) -> DataFrame:
    return df.where(level & (total if keep_totals else ~total))
