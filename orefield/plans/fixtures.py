"""Views over the given tables that have the shapes of the engine's inputs, in Spark and in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.raster import Grid
from ..sources.tables import scan_features

#: 0.25 degree pixels from 68 E, 38 N
GRID = Grid(68.0, 38.0, 0.25, -999.0)

_SITES = "c_custkey AS site_id, 6 + ((c_custkey * 7919) % 32000) / 1e3 AS lat, 68 + ((c_custkey * 104729) % 30000) / 1e3 AS lon, (c_custkey * 31) % 37 AS unit_id, (c_custkey * 17) % 12 AS material_id, c_mktsegment AS status"
_CELLS = "p_partkey AS cell_id, 6 + ((p_partkey * 15485863) % 32000) / 1e3 AS lat, 68 + ((p_partkey * 32452843) % 30000) / 1e3 AS lon, CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE (p_partkey * 13) % 37 END AS unit_id"
_VERTICES = "n_nationkey AS region_id, v.seq, 68 + (n_nationkey % 5) * 6 + v.dx AS x, 6 + floor(n_nationkey / 5) * 64e-1 + v.dy AS y"
_CORNERS = "(VALUES (0, 0e0, 0e0), (1, 55e-1, -5e-1), (2, 65e-1, 3e0), (3, 4e0, 5e0), (4, 3e0, 68e-1), (5, -2e-1, 5e0)) AS v(seq, dx, dy)"
#: Two-part districts with holes in both parts; every third one is its plain outline. The second part overlaps a neighbour.
_PARTS = (
    (0, 0, ((0.0, 0.0), (5.5, -0.5), (6.5, 3.0), (4.0, 5.0), (3.0, 6.8), (-0.2, 5.0))),
    (0, 1, ((2.0, 1.5), (3.5, 1.5), (3.5, 3.0), (2.0, 3.0))),
    (1, 0, ((4.5, 5.2), (7.3, 4.6), (6.6, 6.1))),
    (1, 1, ((6.3, 5.0), (6.8, 4.95), (6.6, 5.4))),
)
_PART_ROWS = ", ".join(f"({part}, {ring}, {seq}, {dx!r}, {dy!r})" for part, ring, points in _PARTS for seq, (dx, dy) in enumerate(points)).replace(".0,", "e0,").replace(".0)", "e0)")
_DISTRICTS = f"SELECT n_nationkey AS district_id, part, ring, seq, 68 + (n_nationkey % 5) * 6 + CAST(dx AS DOUBLE) AS x, 6 + floor(n_nationkey / 5) * 64e-1 + CAST(dy AS DOUBLE) AS y FROM nation CROSS JOIN (VALUES {_PART_ROWS}) v(part, ring, seq, dx, dy) WHERE n_nationkey % 3 > 0 OR (part = 0 AND ring = 0)"
#: Blocks around cells, by cell_id % 5: a square, corners in the wrong order, a crossing ring with an inner point, two parts (one in the wrong order), two points
_SHAPES = "(VALUES (0, 0, 0, 0e0, 0e0), (0, 0, 1, 1e-1, 0e0), (0, 0, 2, 1e-1, 1e-1), (0, 0, 3, 0e0, 1e-1), (1, 0, 0, 0e0, 0e0), (1, 0, 1, 12e-2, 1e-1), (1, 0, 2, 1e-1, 0e0), (1, 0, 3, 0e0, 11e-2), (2, 0, 0, 0e0, 0e0), (2, 0, 1, 1e-1, 1e-1), (2, 0, 2, 1e-1, 0e0), (2, 0, 3, 0e0, 1e-1), (2, 0, 4, 4e-2, 5e-2), (3, 0, 0, 0e0, 0e0), (3, 0, 1, 1e-1, 0e0), (3, 0, 2, 5e-2, 8e-2), (3, 1, 0, 3e-1, 0e0), (3, 1, 1, 4e-1, 1e-1), (3, 1, 2, 41e-2, 0e0), (3, 1, 3, 3e-1, 9e-2), (4, 0, 0, 0e0, 0e0), (4, 0, 1, 1e-1, 1e-1)) AS v(kind, part, seq, dx, dy)"
_BLOCKS = "cell_id, v.part, v.seq, lon + v.dx AS x, lat + v.dy AS y"
_RASTER = "o_orderkey % 128 AS row, CAST(floor(o_orderkey / 128) AS BIGINT) % 120 AS col, CASE WHEN max(o_orderkey) % 97 = 0 THEN -999e0 ELSE CAST(max(o_orderkey * 131 + o_custkey * 197) % 4001 AS DOUBLE) END AS value"
_SERIES = "user_id AS point_id, event_type AS parameter, CAST(ts AS DATE) AS obs_date, event_id, CASE WHEN event_id % 61 = 0 THEN -999e0 ELSE value END AS value"
_INSPECTIONS = "o_orderkey AS record_id, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey END AS code, o_orderpriority AS office, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS inspected_on, year(o_orderdate) AS fiscal_year, o_custkey AS mine"
_SUBTOTALS = "l_orderkey, l_linenumber, l_quantity AS a, l_extendedprice AS b, l_tax AS c, l_quantity + l_extendedprice + l_tax + CASE WHEN l_orderkey % 101 = 0 THEN l_extendedprice * 1e-1 + 5 ELSE 0 END AS total"
_BANDS = "vec_id, label, CAST(abs(embedding[{0}]) AS DOUBLE) AS b02, CAST(abs(embedding[{1}]) AS DOUBLE) AS b03, CAST(abs(embedding[{2}]) AS DOUBLE) AS b04, CAST(abs(embedding[{3}]) AS DOUBLE) AS b08, CAST(abs(embedding[{4}]) AS DOUBLE) AS b11, CAST(embedding[{5}] AS DOUBLE) AS b12"

#: The views as common table expressions for DuckDB.
PRELUDE = f"""WITH RECURSIVE sites AS (SELECT {_SITES} FROM customer), cells AS (SELECT {_CELLS} FROM part),
vertices AS (SELECT {_VERTICES} FROM nation CROSS JOIN {_CORNERS}),
edges AS (SELECT region_id, seq, x AS x1, y AS y1, coalesce(lead(x) OVER w, first(x) OVER w) AS x2, coalesce(lead(y) OVER w, first(y) OVER w) AS y2 FROM vertices WINDOW w AS (PARTITION BY region_id ORDER BY seq)),
districts AS ({_DISTRICTS}), dedges AS (SELECT district_id, part, ring, seq, x AS x1, y AS y1, coalesce(lead(x) OVER w, first(x) OVER w) AS x2, coalesce(lead(y) OVER w, first(y) OVER w) AS y2 FROM districts WINDOW w AS (PARTITION BY district_id, part, ring ORDER BY seq)),
blocks AS (SELECT {_BLOCKS} FROM cells JOIN {_SHAPES} ON cell_id % 5 = kind),
raster AS (SELECT {_RASTER} FROM orders GROUP BY ALL), series AS (SELECT {_SERIES} FROM events),
inspections AS (SELECT {_INSPECTIONS} FROM orders), subtotals AS (SELECT {_SUBTOTALS} FROM lineitem),
bands AS (SELECT {_BANDS.format(*range(1, 7))} FROM embeddings)"""


class Fixtures:
    """The given tables of one folder, and the views."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @staticmethod
    def _pick(df: DataFrame, text: str) -> DataFrame:
        """text is a SELECT list whose commas at depth 0 divide expressions."""
        parts, depth, start = [], 0, 0
        for i, c in enumerate(text):
            depth += c == "("
            depth -= c == ")"
            if c == "," and not depth:
                parts.append(text[start:i])
                start = i + 1
        return df.selectExpr(*parts, text[start:])

    @cached_property
    def sites(self) -> DataFrame:
        return self._pick(self.customer, _SITES)

    @cached_property
    def cells(self) -> DataFrame:
        return self._pick(self.part, _CELLS)

    @cached_property
    def vertices(self) -> DataFrame:
        corners = self.spark.sql(f"SELECT * FROM {_CORNERS}")
        return self._pick(self.nation.crossJoin(F.broadcast(corners)).alias("v"), _VERTICES)  # six corners

    @cached_property
    def districts(self) -> DataFrame:
        """The vertices that scan_features() reads from feature collections of the districts."""
        x0, y0 = F.expr("68 + (n_nationkey % 5) * 6"), F.expr("6 + floor(n_nationkey / 5) * 64e-1")
        ring = lambda points: F.array(*[F.array(x0 + F.lit(dx), y0 + F.lit(dy)) for dx, dy in (*points, points[0])])
        part = lambda n: F.array(*[ring(points) for p, _, points in _PARTS if p == n])
        shape = lambda kind, coordinates: F.to_json(F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")))
        geometry = F.when(F.col("n_nationkey") % 3 > 0, shape("MultiPolygon", F.array(part(0), part(1)))).otherwise(shape("Polygon", F.array(ring(_PARTS[0][2]))))
        text = F.concat(F.lit('{"features":[{"id":"'), F.col("n_nationkey").cast("string"), F.lit('","properties":{},"geometry":'), geometry, F.lit("}]}"))
        _, vertices = scan_features(self.nation.select(text.alias("text")), "text", "name:string")
        return vertices.select(F.col("feature").cast("long").alias("district_id"), "part", "ring", "seq", "x", "y")

    @cached_property
    def blocks(self) -> DataFrame:
        shapes = self.spark.sql(f"SELECT * FROM {_SHAPES}")
        return self._pick(self.cells.join(F.broadcast(shapes).alias("v"), F.expr("cell_id % 5 = kind")), _BLOCKS)  # 23 corners

    @cached_property
    def raster(self) -> DataFrame:
        keys = self.orders.selectExpr("o_orderkey % 128 AS row", "floor(o_orderkey / 128) % 120 AS col", "o_orderkey", "o_custkey")
        return keys.groupBy("row", "col").agg(F.expr("CASE WHEN max(o_orderkey) % 97 = 0 THEN -999e0 ELSE CAST(max(o_orderkey * 131 + o_custkey * 197) % 4001 AS DOUBLE) END AS value"))

    @cached_property
    def series(self) -> DataFrame:
        return self._pick(self.events, _SERIES)

    @cached_property
    def inspections(self) -> DataFrame:
        return self._pick(self.orders, _INSPECTIONS)

    @cached_property
    def subtotals(self) -> DataFrame:
        return self._pick(self.lineitem, _SUBTOTALS)

    @cached_property
    def bands(self) -> DataFrame:
        return self._pick(self.embeddings, _BANDS.format(*range(6)))

    @cached_property
    def evidence(self) -> DataFrame:
        return self.sites

    @cached_property
    def materials(self) -> DataFrame:
        return self.sites.select("material_id").distinct()
