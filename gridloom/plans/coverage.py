"""Registered queries for what the catalog's other queries do not reach, with the SQL that must give the same rows."""

from __future__ import annotations

import json
import math

from pyspark.sql import functions as F

from gridloom.cube import Cube
from gridloom.functions import arrays as A
from gridloom.functions import crs as C
from gridloom.functions import reducers as R
from gridloom.functions import scalar as S
from gridloom.plans.catalog import DENSE, GRID, ORACLES, QUERIES, grid, orders_cube, query, r6, read, shown
from gridloom.schema import VALUE, BBox
from gridloom.sources.cubes import create_data_cube
from gridloom.sources.stac import load_stac
from gridloom.sources.vectors import GEOMETRY, VectorCube, load_geojson, load_url, load_vector_cube, vector_buffer, vector_reproject

# Scalars and arrays


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, exp(1) AS e, pi() AS pi, CAST(NULL AS DOUBLE) AS nan, 7 AS constant, round(l_tax + l_discount, 6) AS added, ceil(l_tax * 100 - 3.5) AS up,
trunc(l_tax * 100 - 3.5) AS whole, round(exp(l_tax), 6) AS exp, round(atan(l_tax), 6) AS atan, round(cosh(l_tax), 6) AS cosh, round(tanh(l_tax), 6) AS tanh, round(asinh(l_tax), 6) AS asinh, round(acosh(l_quantity), 6) AS acosh,
round(atanh(l_tax), 6) AS atanh, abs(l_quantity - 25) AS abs, CAST(sign(l_quantity - 25) AS DOUBLE) AS sgn, least(greatest(l_quantity, 10), 40) AS clip FROM lineitem""")
def scalar_math_more(spark, sf):
    q, d, t = (F.col(c) for c in ("l_quantity", "l_discount", "l_tax"))
    hundred = t * 100 - 3.5
    return read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.e().alias("e"), S.pi().alias("pi"), S.nan().alias("nan"), S.constant(7).alias("constant"), r6(S.add(t, d)).alias("added"), S.ceil(hundred).alias("up"), S._int(hundred).alias("whole"),
        r6(S.exp(t)).alias("exp"), r6(S.arctan(t)).alias("atan"), r6(S.cosh(t)).alias("cosh"), r6(S.tanh(t)).alias("tanh"), r6(S.arsinh(t)).alias("asinh"), r6(S.arcosh(q)).alias("acosh"), r6(S.artanh(t)).alias("atanh"), S.absolute(q - 25).alias("abs"), S.sgn(q - 25).alias("sgn"), S.clip(q, 10, 40).alias("clip"),
    )


ODD = "CASE user_id % 5 WHEN 0 THEN NULL WHEN 1 THEN CAST('NaN' AS DOUBLE) WHEN 2 THEN CAST('Infinity' AS DOUBLE) ELSE value END"


@query(f"""SELECT event_id, event_type <> 'view' AS neq, value < 50 AS lt, value <= 50 AS lte, value >= 50 AS gte, v IS NULL OR isnan(v) AS nan, v IS NULL AS nodata, v IS NOT NULL AND isinf(v) AS inf,
v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v) AS valid, NOT (value > 50) AS negated FROM (SELECT *, {ODD} AS v FROM events)""")
def scalar_logic_more(spark, sf):
    v, u = F.col("value"), F.col("user_id") % 5
    odd = F.when(u == 0, None).when(u == 1, F.lit(float("nan"))).when(u == 2, F.lit(float("inf"))).otherwise(v)
    return read(spark, sf, "events").select(
        "event_id", S.neq(F.col("event_type"), "view").alias("neq"), S.lt(v, 50).alias("lt"), S.lte(v, 50).alias("lte"), S.gte(v, 50).alias("gte"), S.is_nan(odd).alias("nan"), S.is_nodata(odd).alias("nodata"), S.is_infinite(odd).alias("inf"),
        S.is_valid(odd).alias("valid"), S._not(v > 50).alias("negated"),
    )


@query("""SELECT vec_id, [e[1], e[2], e[1], e[2]] AS made, e[2] AS of_b, list_concat(e, [9.5::DOUBLE]) AS longer, 9.5::DOUBLE AS of_d, 1::BIGINT AS at_b, CAST(NULL AS BIGINT) AS at_z, list_filter(e, lambda x: x > 0) AS positive,
list_concat(e[1:1], [100.0::DOUBLE], e[3:3]) AS modified, 3::BIGINT AS n_modified FROM (SELECT vec_id, list_transform(embedding[1:3], lambda x: round(CAST(x AS DOUBLE), 6)) AS e FROM embeddings)""")
def array_labels(spark, sf):
    rows = read(spark, sf, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 3), lambda v: F.round(v.cast("double"), 6)).alias("e"))
    e = F.col("e")
    named = A.array_create_labeled(e, ["a", "b", "c"])
    longer = A.array_append(named, 9.5, "d")
    changed = A.array_modify(named, A.array_create_labeled(F.array(F.lit(100.0)), ["z"]), 1, 1, labeled=True)
    return rows.select(
        "vec_id", A.array_create([F.get(e, F.lit(0)), F.get(e, F.lit(1))], 2).alias("made"), A.array_element(named, label="b", labeled=True).alias("of_b"), A.array_append(e, 9.5).alias("longer"), A.array_element(longer, label="d", labeled=True).alias("of_d"),
        A.array_find_label(named, "b").cast("long").alias("at_b"), A.array_find_label(named, "z").cast("long").alias("at_z"), A.array_filter(e, lambda x: x > 0).alias("positive"), A.values(changed).alias("modified"), F.size(A.labels(changed)).cast("long").alias("n_modified"),
    )


# Time and labels


@query("SELECT ((year(o_orderdate) - 1) // 10 * 10 + 1)::VARCHAR AS t, o_orderstatus AS bands, round(sum(o_totalprice), 2) AS value FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1, 2")
def period_decade_ad(spark, sf):
    out = orders_cube(spark, sf).aggregate_temporal_period(R._sum, "decade-ad", closed="left")
    return out.df.select("t", "bands", F.round(VALUE, 2).alias(VALUE)).filter("value IS NOT NULL")


@query(GRID + "SELECT DISTINCT 'x' AS dim, 'x' AS kind, CAST(x AS VARCHAR) AS label FROM g UNION ALL SELECT DISTINCT 'bands', 'bands', bands FROM g UNION ALL SELECT 'run', 'temporal', 'now'")
def labels_and_types(spark, sf):
    c = grid(spark, sf).add_dimension("run", "now").add_dim_type("run", "temporal").inspect("labels", level="debug")
    tables = [c.label_table(d).select(F.lit(d).alias("dim"), F.lit(c.schema.dim(d).type).alias("kind"), F.col(d).cast("string").alias("label")) for d in ("x", "bands", "run")]
    return tables[0].union(tables[1]).union(tables[2])


@query("SELECT 0::BIGINT AS cells, 0 AS dims")
def create_cube(spark, sf):
    c = create_data_cube(spark)
    return c.df.agg(F.count("*").alias("cells"), F.lit(len(c.dims)).alias("dims"))


# Masks and alignment


@query(GRID + ", b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM g) SELECT x, y, bands, CASE WHEN round(x / 2) % 2 = 1 THEN -1 ELSE value END AS value FROM g")
def mask_other_grid(spark, sf):
    """A mask on a coarser grid, of every other pair of columns: it is brought to the grid of the data first."""
    c = grid(spark, sf)
    columns, rows = spark.range(13).select((F.col("id") * 2.0).alias("x")), spark.range(10).select((F.col("id") * 2.0).alias("y"))
    coarse = Cube.of(columns.crossJoin(rows).select("x", "y", (F.col("x") / 2 % 2 == 1).cast("double").alias(VALUE)), ["x", "y"], VALUE, None, "EPSG:3857")
    return shown(c.mask(coarse, -1.0))


@query(GRID + "SELECT x, y, bands, round(value + value * 2, 6) AS value FROM g")
def merge_aligned(spark, sf):
    """Labels that differ by rounding errors are the same."""
    c = grid(spark, sf)
    moved = Cube(c.df.select((F.col("x") + 1e-8).alias("x"), (F.col("y") - 1e-8).alias("y"), "bands", (F.col(VALUE) * 2).alias(VALUE)), c.schema)
    return shown(c.merge_cubes(moved, S.add))


# Resampling

GATHERED = {
    "max": "max(value)", "min": "min(value)", "med": "median(value)", "q1": "quantile_cont(value, 0.25)", "q3": "quantile_cont(value, 0.75)", "sum": "sum(value)", "rms": "sqrt(avg(value * value))",
    "mode": "list_sort(map_keys(histogram(value)))[1 + list_position(map_values(histogram(value)), list_max(map_values(histogram(value)))) - 1]",
}


def dense(spark, sf) -> Cube:
    return grid(spark, sf).densify().apply(lambda x: F.coalesce(x, F.lit(0.0)))


def _gathered(name):
    return lambda spark, sf: shown(dense(spark, sf).resample_spatial(resolution=(6, 6), method=name))


for _name, _sql in GATHERED.items():
    QUERIES[f"resample_{_name}"] = _gathered(_name)
    ORACLES[f"resample_{_name}"] = DENSE + f"SELECT floor(x / 6) * 6 + 2.5 AS x, floor(y / 6) * 6 + 2.5 AS y, bands, round({_sql}, 6) AS value FROM f GROUP BY floor(x / 6), floor(y / 6), bands"

WEIGHTS = {
    "cubic": ("CASE WHEN {a} <= 1 THEN (1.5 * {a} - 2.5) * {a} * {a} + 1 WHEN {a} < 2 THEN ((-0.5 * {a} + 2.5) * {a} - 4) * {a} + 2 ELSE 0 END", 2),
    "cubicspline": ("CASE WHEN {a} <= 1 THEN (0.5 * {a} - 1) * {a} * {a} + 2.0 / 3 WHEN {a} < 2 THEN (2 - {a}) ** 3 / 6 ELSE 0 END", 2),
    "lanczos": ("CASE WHEN {a} < 1e-12 THEN 1 WHEN {a} < 3 THEN 3 * sin(pi() * {a}) * sin(pi() * {a} / 3) / (pi() * {a}) ** 2 ELSE 0 END", 3),
}


def _weighed(name):
    def run(spark, sf):
        c = dense(spark, sf)
        columns = spark.range(22).select((F.col("id") + 0.5).alias("x"))
        rows = spark.range(16).select((F.col("id") + 0.25).alias("y"))
        target = Cube.of(columns.crossJoin(rows).withColumn(VALUE, F.lit(0.0)), ["x", "y"], VALUE, None, "EPSG:3857")
        out = c.resample_cube_spatial(target, name).df
        return out.select("x", "y", "bands", r6(F.col(VALUE) + 1e-9).alias(VALUE))  # a hair more, as some end in a 5 at the seventh place

    return run


for _name, (_sql, _reach) in WEIGHTS.items():
    _w = f"({_sql.format(a='abs(f.x - t.x)')}) * ({_sql.format(a='abs(f.y - t.y)')})"
    QUERIES[f"resample_{_name}"] = _weighed(_name)
    ORACLES[f"resample_{_name}"] = DENSE + f""", t AS (SELECT a.i + 0.5 AS x, b.i + 0.25 AS y FROM range(22) a(i) CROSS JOIN range(16) b(i))
SELECT CAST(t.x AS DOUBLE) AS x, CAST(t.y AS DOUBLE) AS y, bs.bands, round(sum(f.value * {_w}) / sum({_w}) + 1e-9, 6) AS value FROM t CROSS JOIN bs LEFT JOIN f ON f.bands = bs.bands AND abs(f.x - t.x) < {_reach} AND abs(f.y - t.y) < {_reach} GROUP BY ALL"""


# Vectors: suppliers as points, by longitude s_nationkey and latitude s_acctbal / 200


def suppliers(spark, sf, crs="EPSG:4326") -> VectorCube:
    s = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("geom_id"), F.col("s_nationkey").cast("double").alias("x"), (F.col("s_acctbal") / 200).alias("y"), "s_acctbal")
    point = F.to_json(F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates")))
    return VectorCube(s.select("geom_id", point.alias(GEOMETRY), "s_acctbal"), crs)


def points(v: VectorCube):
    at = F.from_json(GEOMETRY, "type string, coordinates array<double>")["coordinates"]
    return v.df.select("geom_id", at[0].alias("x"), at[1].alias("y"))


@query("SELECT s_suppkey AS geom_id, CAST(s_nationkey AS DOUBLE) AS x, round(s_acctbal / 200, 6) AS y FROM supplier WHERE s_nationkey BETWEEN 3 AND 17 AND s_acctbal / 200 BETWEEN 0 AND 30")
def vector_filter_bbox(spark, sf):
    return points(suppliers(spark, sf).filter_bbox(BBox(3, 0, 17, 30))).select("geom_id", "x", r6("y").alias("y"))


@query("SELECT s_suppkey AS geom_id, round(s_nationkey * pi() / 180 * 6378137, 4) AS x, round(ln(tan(pi() / 4 + s_acctbal / 200 * pi() / 360)) * 6378137, 4) AS y FROM supplier")
def vector_reprojected(spark, sf):
    return points(vector_reproject(suppliers(spark, sf), 3857)).select("geom_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("SELECT s_suppkey AS geom_id, round(s_nationkey - 2.5, 6) AS west, round(s_nationkey + 2.5, 6) AS east, round(s_acctbal / 200 - 2.5, 6) AS south, round(s_acctbal / 200 + 2.5, 6) AS north FROM supplier")
def vector_buffered(spark, sf):
    grown = vector_buffer(suppliers(spark, sf, "EPSG:3857"), 2.5).df
    ring = F.from_json(GEOMETRY, "type string, coordinates array<array<array<array<double>>>>")["coordinates"][0][0]
    x, y = F.transform(ring, lambda p: p[0]), F.transform(ring, lambda p: p[1])
    return grown.select("geom_id", r6(F.array_min(x)).alias("west"), r6(F.array_max(x)).alias("east"), r6(F.array_min(y)).alias("south"), r6(F.array_max(y)).alias("north"))


@query("SELECT s_suppkey AS geometry, 's_acctbal' AS properties, s_acctbal AS value FROM supplier")
def vector_cells(spark, sf):
    return suppliers(spark, sf).to_cube().df


CITIES = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"id": i, "size": 2.5 * i}, "geometry": {"type": "Point", "coordinates": [10 + i, 46]}} for i in range(5)]}


@query("SELECT 'inline' AS source, CAST(i AS BIGINT) AS geom_id, CAST(i AS DOUBLE) AS id, CAST(2.5 * i AS DOUBLE) AS size, CAST(10 + i AS DOUBLE) AS x FROM range(5) t(i) UNION ALL SELECT 'text', CAST(i AS BIGINT), CAST(i AS DOUBLE), CAST(2.5 * i AS DOUBLE), CAST(10 + i AS DOUBLE) FROM range(5) t(i)")
def load_vectors(spark, sf):
    parts = [("inline", load_vector_cube(spark, geometries=CITIES)), ("text", load_geojson(spark, json.dumps(CITIES)))]
    each = [v.df.select(F.lit(name).alias("source"), "geom_id", "id", "size", F.get_json_object(GEOMETRY, "$.coordinates[0]").cast("double").alias("x")) for name, v in parts]
    return each[0].union(each[1])


@query("SELECT doc_id, lang, geometry FROM (SELECT doc_id, lang, CAST(NULL AS VARCHAR) AS geometry FROM documents) WHERE false UNION ALL SELECT p_partkey, p_brand, p_name FROM part")
def load_url_parquet(spark, sf):
    """A Parquet table by its address; its column of geometries is taken as it is."""
    from tempfile import mkdtemp

    folder = spark.conf.get("spark.checkpoint.dir", None) or mkdtemp()
    path = f"{folder.rstrip('/')}/load_url_parquet"
    read(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_brand").alias("lang"), F.col("p_name").alias("geometries")).write.mode("overwrite").parquet(path)
    return load_url(spark, path, "parquet").df.select("doc_id", "lang", "geometry")


@query(f"SELECT round(CAST({11.25 * math.pi / 180 * 6378137!r} AS DOUBLE), 4) AS west, round(CAST({math.log(math.tan(math.pi / 4 + 46.5 * math.pi / 360)) * 6378137!r} AS DOUBLE), 4) AS south, round(CAST({13.5 * math.pi / 180 * 6378137!r} AS DOUBLE), 4) AS east, round(CAST({math.log(math.tan(math.pi / 4 + 48 * math.pi / 360)) * 6378137!r} AS DOUBLE), 4) AS north")
def reproject_box(spark, sf):
    box = C.reproject_bbox(BBox(11.25, 46.5, 13.5, 48), 3857)
    return spark.range(1).select(*[F.round(F.lit(v), 4).alias(n) for n, v in (("west", box.west), ("south", box.south), ("east", box.east), ("north", box.north))])


@query("SELECT ts AS t, user_id AS y, event_type AS bands, CASE WHEN value = 50 THEN NULL ELSE round(value, 6) END AS value FROM events WHERE event_type IN ('click', 'view') AND user_id BETWEEN 5 AND 60 AND ts >= '2024-01-05' AND ts < '2024-01-25'")
def load_stac_item(spark, sf):
    """An item whose asset is a Parquet table of cells."""
    from tempfile import mkdtemp

    folder = spark.conf.get("spark.checkpoint.dir", None) or mkdtemp()
    path = f"{folder.rstrip('/')}/load_stac_item"
    read(spark, sf, "events").select(F.col("ts").alias("t"), F.col("user_id").cast("double").alias("y"), F.lit(1.0).alias("x"), F.col("event_type").alias("bands"), VALUE).write.mode("overwrite").parquet(path)
    item = {
        "type": "Feature", "stac_version": "1.0.0", "id": "events", "assets": {"data": {"href": path}},
        "properties": {"cube:dimensions": {"t": {"type": "temporal"}, "x": {"type": "spatial", "axis": "x", "reference_system": 3857}, "y": {"type": "spatial", "axis": "y"}}, "cube:variables": {b: {"nodata": 50} for b in ("click", "error", "purchase", "signup", "view")}},
    }
    cube = load_stac(spark, "item", BBox(0, 5, 2, 60, 3857), ("2024-01-05", "2024-01-25"), ["click", "view"], fetch=lambda url: item)
    return cube.df.select("t", F.col("y").cast("long").alias("y"), "bands", r6().alias(VALUE))
