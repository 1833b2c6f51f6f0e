"""Registered queries of the cube engine, each with SQL that must give the same rows.

Cubes: `events` (t, bands = event type, user_id) and a `grid` of line items (x, y, bands = return flag). Floats are rounded on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.cube import Cube
from gridloom.functions import arrays as A
from gridloom.functions import reducers as R
from gridloom.functions import scalar as S
from gridloom.plans.graph import Graph
from gridloom.schema import VALUE, BBox

QUERIES: dict = {}
ORACLES: dict = {}
TYPES = ["click", "error", "purchase", "signup", "view"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark, sf) -> Cube:
    df = read(spark, sf, "events").select(F.col("ts").alias("t"), F.col("event_type").alias("bands"), "user_id", F.col("value").alias(VALUE))
    return Cube.of(df, ["t", "bands", "user_id"], VALUE, TYPES)


def holed(spark, sf) -> Cube:
    """events with a NULL for one user in seven."""
    c = events(spark, sf)
    return c.with_value(F.when(F.col("user_id") % 7 != 0, F.col(VALUE)))


def grid(spark, sf) -> Cube:
    li = read(spark, sf, "lineitem").filter("l_returnflag IS NOT NULL")
    keys = (F.col("l_suppkey") % 24).cast("double").alias("x"), (F.col("l_partkey") % 18).cast("double").alias("y"), F.col("l_returnflag").alias("bands")
    return Cube.of(li.groupBy(*keys).agg(F.sum("l_quantity").alias(VALUE)), ["x", "y", "bands"], VALUE, ["A", "N", "R"], "EPSG:3857")


GRID = "WITH g AS (SELECT CAST(l_suppkey % 24 AS DOUBLE) AS x, CAST(l_partkey % 18 AS DOUBLE) AS y, l_returnflag AS bands, sum(l_quantity) AS value FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY ALL) "
HOLED = "WITH h AS (SELECT ts AS t, event_type AS bands, user_id, CASE WHEN user_id % 7 <> 0 THEN value END AS value FROM events) "


def r6(c: str | object = VALUE):
    """Six decimals, in binary: F.round would go through decimals, which takes ten times as long."""
    return F.rint((F.col(c) if isinstance(c, str) else c) * 1e6) / 1e6


def shown(cube: Cube) -> DataFrame:
    return cube.df.select(*cube.dims, r6().alias(VALUE))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Daily mean of each event type over a fortnight, with empty days."""
    c = events(spark, sf).filter_temporal(("2024-01-08", "2024-01-22"))
    daily = Cube(c.df.select("t", "bands", VALUE), c.schema.without("user_id")).aggregate_temporal_period(R.mean, "day")
    return shown(daily)


@query("""WITH e AS (SELECT date_trunc('day', ts)::TIMESTAMP AS t, event_type AS bands, avg(value) AS v FROM events WHERE ts >= '2024-01-08' AND ts < '2024-01-22' GROUP BY ALL),
d AS (SELECT unnest(generate_series((SELECT min(t) FROM e), (SELECT max(t) FROM e), INTERVAL 1 DAY)) AS t)
SELECT d.t, b.bands, round(v, 6) AS value FROM d CROSS JOIN (SELECT DISTINCT bands FROM e) b LEFT JOIN e ON e.t = d.t AND e.bands = b.bands""")
def period_day(spark, sf):
    return flagship(spark, sf)


# Reducers

REDUCED = {
    "min": "min(value)", "max": "max(value)", "sum": "coalesce(sum(value), 0)", "mean": "avg(value)", "median": "median(value)", "sd": "stddev_samp(value)",
    "variance": "var_samp(value)", "count": "count(value)",
}


def _reduced(name):
    reducer = getattr(R, name if hasattr(R, name) else f"_{name}")

    def run(spark, sf):
        out = holed(spark, sf).reduce_dimension(reducer, "t")
        return out.df.select("bands", "user_id", r6(F.col(VALUE).cast("double")).alias(VALUE))

    return run


for _name, _sql in REDUCED.items():
    QUERIES[f"reduce_{_name}"] = _reduced(_name)
    ORACLES[f"reduce_{_name}"] = HOLED + f"SELECT bands, user_id, round(CAST({_sql} AS DOUBLE), 6) AS value FROM h GROUP BY bands, user_id"


@query(HOLED + "SELECT bands, round(CASE WHEN count(value) < count(*) THEN NULL ELSE avg(value) END, 6) AS value, t FROM (SELECT bands, value, date_trunc('hour', t) AS t FROM h) GROUP BY bands, t")
def reduce_keep_nodata(spark, sf):
    c = holed(spark, sf)
    hourly = Cube(c.df.withColumn("t", F.date_trunc("hour", "t").cast("timestamp_ntz")), c.schema)
    return shown(hourly.reduce_dimension(lambda d: R.mean(d, ignore_nodata=False), "user_id"))


@query("SELECT event_type AS bands, round(quantile_cont(value, CAST(0.25 AS DOUBLE)), 6) AS q1, round(quantile_cont(value, CAST(0.5 AS DOUBLE)), 6) AS q2, round(quantile_cont(value, CAST(0.75 AS DOUBLE)), 6) AS q3, round(min(value), 6) AS low, round(max(value), 6) AS high FROM events GROUP BY event_type")
def reduce_quantiles_extrema(spark, sf):
    c = events(spark, sf)
    one = Cube(c.df.withColumn("k", F.struct("t", "user_id")).select("bands", "k", VALUE), c.schema.without("t", "user_id"))
    q = one.df.groupBy("bands").agg(R.quantiles(R.Group(F.col(VALUE)), q=4).alias("q"), R.extrema(R.Group(F.col(VALUE))).alias("e"))
    return q.select("bands", *[r6(F.col("q")[i]).alias(f"q{i + 1}") for i in range(3)], r6(F.col("e")[0]).alias("low"), r6(F.col("e")[1]).alias("high"))


@query(HOLED + "SELECT bands, user_id, round(arg_min(value, t), 6) AS first, round(arg_max(value, t), 6) AS last, count(*) FILTER (value > 50) AS n, coalesce(bool_or(value > 90), false) AS some, coalesce(bool_and(value > 1), true) AS every, count(*) AS cells FROM h GROUP BY bands, user_id")
def reduce_edges_logic(spark, sf):
    c = holed(spark, sf)
    g = R.Group(F.col(VALUE), F.col("t"))
    flags, all_flags = R.Group(F.col(VALUE) > 90), R.Group(F.col(VALUE) > 1)
    return c.df.groupBy("bands", "user_id").agg(r6(R.first(g)).alias("first"), r6(R.last(g)).alias("last"), R.count(g, lambda x: x > 50).alias("n"), R._any(flags).alias("some"), R._all(all_flags).alias("every"), R.count(g, True).alias("cells"))


@query("SELECT l_orderkey, round(product(1 + l_tax) + 1e-9, 6) AS value FROM lineitem GROUP BY l_orderkey")
def reduce_product(spark, sf):
    li = read(spark, sf, "lineitem")
    c = Cube.of(li.select("l_linenumber", "l_orderkey", (1 + F.col("l_tax")).alias(VALUE)), ["l_linenumber", "l_orderkey"])
    out = c.reduce_dimension(R.product, "l_linenumber").df
    return out.select("l_orderkey", r6(F.col(VALUE) + 1e-9).alias(VALUE))  # a hair more, as some products end in a 5 at the seventh place


@query("SELECT user_id, t, round(max(value) FILTER (bands = 'view'), 6) AS value FROM (SELECT ts AS t, event_type AS bands, user_id, value FROM events) GROUP BY user_id, t")
def reduce_array_element(spark, sf):
    return events(spark, sf).reduce_dimension(lambda d: R.array_element(d, label="view", return_nodata=True), "bands").df.select("user_id", "t", r6().alias(VALUE))


@query(GRID + "SELECT bands, round(avg(value), 6) AS value FROM g GROUP BY bands")
def reduce_spatial(spark, sf):
    return shown(grid(spark, sf).reduce_spatial(R.mean))


# Time

PERIODS = {
    "hour": ("date_trunc('hour', ts)", "INTERVAL 1 HOUR"), "week": ("date_trunc('week', ts) + INTERVAL 6 DAY", "INTERVAL 7 DAY"),
}


def _period(name):
    def run(spark, sf):
        c = events(spark, sf)
        return shown(Cube(c.df.select("t", "bands", VALUE), c.schema.without("user_id")).aggregate_temporal_period(R._sum, name))

    return run


for _name, (_label, _step) in PERIODS.items():
    QUERIES[f"period_{_name}"] = _period(_name)
    ORACLES[f"period_{_name}"] = f"""WITH e AS (SELECT CAST({_label} AS TIMESTAMP) AS t, event_type AS bands, sum(value) AS v FROM events GROUP BY ALL),
d AS (SELECT unnest(generate_series((SELECT min(t) FROM e), (SELECT max(t) FROM e), {_step})) AS t)
SELECT d.t, b.bands, round(v, 6) AS value FROM d CROSS JOIN (SELECT DISTINCT bands FROM e) b LEFT JOIN e ON e.t = d.t AND e.bands = b.bands"""


def orders_cube(spark, sf) -> Cube:
    o = read(spark, sf, "orders").filter("o_orderdate IS NOT NULL")
    return Cube.of(o.select(F.col("o_orderdate").alias("t"), F.col("o_orderstatus").alias("bands"), F.col("o_totalprice").alias(VALUE)), ["t", "bands"])


LONG = {
    "month": "CAST(last_day(CAST(o_orderdate AS DATE)) AS TIMESTAMP)", "year": "CAST(date_trunc('year', o_orderdate) AS TIMESTAMP)",
    "season": "CAST(CAST(date_trunc('quarter', CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH) AS DATE) - INTERVAL 1 MONTH AS TIMESTAMP)",
}


def _long_period(name):
    def run(spark, sf):
        out = orders_cube(spark, sf).aggregate_temporal_period(R._max, name)
        return shown(out).filter("value IS NOT NULL")

    return run


for _name, _label in LONG.items():
    QUERIES[f"period_{_name}"] = _long_period(_name)
    ORACLES[f"period_{_name}"] = f"SELECT {_label} AS t, o_orderstatus AS bands, round(max(o_totalprice), 6) AS value FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1, 2"


@query("""SELECT CASE WHEN month(t) BETWEEN 5 AND 10 THEN year(t) || '-mjjaso' WHEN month(t) > 10 THEN year(t) || '-ndjfma' ELSE (year(t) - 1) || '-ndjfma' END AS t, o_orderstatus AS bands, round(max(v), 6) AS value
FROM (SELECT o_orderdate AS t, o_orderstatus, o_totalprice AS v FROM orders WHERE o_orderdate IS NOT NULL) GROUP BY 1, 2""")
def period_tropical_season(spark, sf):
    return shown(orders_cube(spark, sf).aggregate_temporal_period(R._max, "tropical-season", closed="left")).filter("value IS NOT NULL")


@query("SELECT (year(o_orderdate) // 10 * 10)::VARCHAR AS t, o_orderstatus AS bands, round(sum(o_totalprice), 2) AS value FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1, 2")
def period_decade(spark, sf):
    out = orders_cube(spark, sf).aggregate_temporal_period(R._sum, "decade", closed="left")
    return out.df.select("t", "bands", F.round(VALUE, 2).alias(VALUE)).filter("value IS NOT NULL")


@query("""WITH k AS (SELECT year(o_orderdate) AS y, make_date(year(o_orderdate), month(o_orderdate), CAST(least((day(o_orderdate) - 1) // 10, 2) * 10 + 1 AS BIGINT)) AS d, o_orderstatus AS bands, o_totalprice AS v FROM orders WHERE o_orderdate IS NOT NULL)
SELECT y || '-' || lpad(CAST(dayofyear(d) // 10 AS VARCHAR), 2, '0') AS t, bands, round(max(v), 6) AS value FROM k GROUP BY 1, 2""")
def period_dekad(spark, sf):
    out = orders_cube(spark, sf).aggregate_temporal_period(R._max, "dekad", closed="left")
    return shown(Cube(out.df.groupBy("t", "bands").agg(F.max(VALUE).alias(VALUE)), out.schema)).filter("value IS NOT NULL")


@query("""WITH i(a, b, t) AS (VALUES (TIMESTAMP '2024-01-03', TIMESTAMP '2024-01-10', 'early'), (TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-20', 'late'))
SELECT i.t, event_type AS bands, round(avg(value), 6) AS value FROM events JOIN i ON date_trunc('second', ts) > a AND date_trunc('second', ts) <= b GROUP BY i.t, event_type""")
def aggregate_intervals(spark, sf):
    c = events(spark, sf)
    flat = Cube(c.df.select("t", "bands", VALUE), c.schema.without("user_id"))
    return shown(flat.aggregate_temporal([("2024-01-03", "2024-01-10"), ("2024-01-10", "2024-01-20")], R.mean, ["early", "late"]))


@query("""WITH o AS (SELECT DISTINCT TIMESTAMP '2024-01-01' + INTERVAL (o_orderkey % 40) DAY + INTERVAL 7 HOUR AS t FROM orders), l AS (SELECT DISTINCT date_trunc('hour', ts)::TIMESTAMP AS t FROM events WHERE value > 95),
n AS (SELECT o.t AS t, arg_min(l.t, abs(epoch_us(l.t) - epoch_us(o.t)) * 2 + (l.t > o.t)::INT) AS u FROM o CROSS JOIN l GROUP BY o.t),
c AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS t, max(value) AS value FROM events WHERE value > 95 GROUP BY 1)
SELECT n.t, round(CASE WHEN abs(epoch_us(n.u) - epoch_us(n.t)) <= 86400000000 THEN c.value END, 6) AS value FROM n JOIN c ON c.t = n.u""")
def resample_cube_temporal(spark, sf):
    ev = read(spark, sf, "events").filter("value > 95").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("t")).agg(F.max("value").alias(VALUE))
    days = read(spark, sf, "orders").select(F.timestamp_add("HOUR", (F.col("o_orderkey") % 40) * 24 + 7, F.lit("2024-01-01").cast("timestamp_ntz")).alias("t"), F.lit(0.0).alias(VALUE)).distinct()
    return shown(Cube.of(ev, ["t"]).resample_cube_temporal(Cube.of(days, ["t"]), valid_within=1))


# Along a dimension


def _running(name):
    def run(spark, sf):
        return shown(holed(spark, sf).apply_dimension(getattr(R, name), "t"))

    return run


for _name, _sql in {"cumsum": "sum(value)", "cummin": "min(value)", "cummax": "max(value)"}.items():
    QUERIES[_name] = _running(_name)
    ORACLES[_name] = HOLED + f"SELECT t, bands, user_id, round(CASE WHEN value IS NOT NULL THEN {_sql} OVER (PARTITION BY bands, user_id ORDER BY t ROWS UNBOUNDED PRECEDING) END, 6) AS value FROM h"


@query("SELECT l_orderkey, l_linenumber, round(exp(sum(ln(1 + l_tax)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING)), 6) AS value FROM (SELECT * FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1)")
def cumproduct(spark, sf):
    li = read(spark, sf, "lineitem")
    unique = li.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.first("l_tax").alias("tax")).filter("n = 1")
    c = Cube.of(unique.select("l_orderkey", "l_linenumber", (1 + F.col("tax")).alias(VALUE)), ["l_orderkey", "l_linenumber"])
    return shown(c.apply_dimension(R.cumproduct, "l_linenumber"))


INTERPOLATED = """WITH h AS (SELECT ts AS t, user_id, CASE WHEN event_id % 3 <> 0 THEN value END AS v FROM events WHERE event_type = 'view'),
w AS (SELECT *, last_value(v IGNORE NULLS) OVER p AS y0, last_value(CASE WHEN v IS NOT NULL THEN epoch_us(t) END IGNORE NULLS) OVER p AS x0, first_value(v IGNORE NULLS) OVER f AS y1, first_value(CASE WHEN v IS NOT NULL THEN epoch_us(t) END IGNORE NULLS) OVER f AS x1 FROM h
WINDOW p AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT t, user_id, round(CASE WHEN v IS NOT NULL OR y0 IS NULL OR y1 IS NULL THEN v ELSE y0 + (y1 - y0) * (epoch_us(t) - x0) / nullif(x1 - x0, 0) END, 4) AS value FROM w"""


@query(INTERPOLATED)
def interpolate_linear(spark, sf):
    e = read(spark, sf, "events").filter("event_type = 'view'").select(F.col("ts").alias("t"), "user_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias(VALUE))
    return Cube.of(e, ["t", "user_id"]).apply_dimension(R.array_interpolate_linear, "t").df.select("t", "user_id", F.round(VALUE, 4).alias(VALUE))


@query("SELECT user_id, t AS t, round(v, 6) AS value FROM (SELECT user_id, unnest(list_sort(list(value))) AS v, unnest(range(0, count(*))) AS t FROM events WHERE event_type = 'error' GROUP BY user_id)")
def apply_dimension_sort(spark, sf):
    e = read(spark, sf, "events").filter("event_type = 'error'").select("user_id", F.col("ts").alias("t"), F.col("value").alias(VALUE))
    ranked = Cube.of(e, ["user_id", "t"])
    out = ranked.apply_dimension(lambda a: F.concat(A.sort(a), F.array(F.lit(None).cast("double"))), "t")
    return out.df.filter("value IS NOT NULL").select("user_id", F.col("t").cast("long").alias("t"), r6().alias(VALUE))


# Dimensions and filters


@query("SELECT ts AS time, event_type AS bands, user_id, 'run1' AS run, round(value, 6) AS value FROM events WHERE ts >= '2024-01-05' AND ts < '2024-01-09T12:00:00' AND event_type IN ('view', 'click')")
def filter_time_bands(spark, sf):
    c = events(spark, sf).filter_temporal(("2024-01-05", "2024-01-09T12:00:00")).filter_bands(["view", "click"])
    return shown(c.add_dimension("run", "run1").rename_dimension("t", "time"))


@query(GRID + "SELECT x, y, bands, value FROM g WHERE x BETWEEN 3 AND 9.5 AND y BETWEEN 2 AND 11 AND bands IN ('A', 'R')")
def filter_bbox_labels(spark, sf):
    return shown(grid(spark, sf).filter_bbox(BBox(3, 2, 9.5, 11, "EPSG:3857")).filter_labels(lambda b: b.isin("A", "R"), "bands"))


@query(GRID + "SELECT x, y, CASE bands WHEN 'A' THEN 'back' WHEN 'R' THEN 'gone' ELSE bands END AS bands, value FROM g")
def rename_labels(spark, sf):
    return shown(grid(spark, sf).rename_labels("bands", ["back", "gone"], ["A", "R"]))


@query(GRID + "SELECT x, y, bands, CASE WHEN bands = 'N' THEN NULL ELSE value END AS value FROM g WHERE bands <> 'N'")
def trim_cube(spark, sf):
    c = grid(spark, sf)
    return shown(c.with_value(F.when(F.col("bands") != "N", F.col(VALUE))).trim_cube())


@query(GRID + "SELECT x, y, value FROM g WHERE bands = 'A'")
def drop_dimension(spark, sf):
    return shown(grid(spark, sf).filter_bands(["A"]).drop_dimension("bands"))


@query("SELECT DISTINCT event_type AS label FROM events")
def dimension_labels(spark, sf):
    return events(spark, sf).label_table("bands").select(F.col("bands").alias("label"))


# Masks and space

SQUARE = {"type": "Polygon", "coordinates": [[[2.5, 1.5], [14.5, 1.5], [14.5, 12.5], [2.5, 12.5], [2.5, 1.5]]], "crs": {"properties": {"name": "EPSG:3857"}}}
TRIANGLE = {"type": "Polygon", "coordinates": [[[0.2, 0.1], [20.3, 3.4], [7.6, 16.7], [0.2, 0.1]]], "crs": {"properties": {"name": "EPSG:3857"}}}
ZONES = {"type": "FeatureCollection", "crs": {"properties": {"name": "EPSG:3857"}}, "features": [{"type": "Feature", "properties": {}, "geometry": g} for g in (SQUARE, TRIANGLE, {"type": "Polygon", "coordinates": [[[90, 90], [99, 90], [99, 99], [90, 90]]]})]}


def _edge(x0, y0, x1, y1):
    return f"(CASE WHEN ({y0} > y) <> ({y1} > y) AND x < ({x1 - x0!r}) * (y - {y0}) / ({y1 - y0!r}) + {x0} THEN 1 ELSE 0 END)"


IN_TRIANGLE = "((" + " + ".join(_edge(*a, *b) for a, b in zip(TRIANGLE["coordinates"][0], TRIANGLE["coordinates"][0][1:])) + ") % 2 = 1)"
IN_SQUARE = "(x > 2.5 AND x < 14.5 AND y > 1.5 AND y < 12.5)"


@query(GRID + f"SELECT x, y, bands, CASE WHEN {IN_TRIANGLE} THEN value END AS value FROM g")
def mask_polygon(spark, sf):
    return shown(grid(spark, sf).mask_polygon(TRIANGLE))


@query(GRID + f"SELECT x, y, bands, CASE WHEN {IN_TRIANGLE} THEN value * 2 ELSE -1 END AS value FROM g")
def apply_polygon(spark, sf):
    return shown(grid(spark, sf).apply_polygon(TRIANGLE, lambda x: S.multiply(x, 2), mask_value=-1.0))


@query(GRID + ", m AS (SELECT x, y, sum(value) > 300 AS hit FROM g GROUP BY x, y) SELECT g.x, g.y, bands, CASE WHEN hit THEN 0 ELSE value END AS value FROM g JOIN m USING (x, y)")
def mask(spark, sf):
    c = grid(spark, sf)
    return shown(c.mask(c.reduce_dimension(R._sum, "bands").apply(lambda x: S.gt(x, 300)), 0.0))


@query(GRID + f""", z AS (SELECT 0 AS geometry, x, y, bands, value FROM g WHERE {IN_SQUARE} UNION ALL SELECT 1, x, y, bands, value FROM g WHERE {IN_TRIANGLE})
SELECT k.geometry, b.bands, round(avg(value), 6) AS value FROM (VALUES (0), (1), (2)) k(geometry) CROSS JOIN (SELECT DISTINCT bands FROM g) b LEFT JOIN z ON z.geometry = k.geometry AND z.bands = b.bands GROUP BY k.geometry, b.bands""")
def aggregate_spatial(spark, sf):
    return shown(grid(spark, sf).aggregate_spatial(ZONES, R.mean))


@query(GRID + f"SELECT x, y, bands, CASE WHEN {IN_TRIANGLE} THEN value END AS value FROM g WHERE x BETWEEN 0.2 AND 20.3 AND y BETWEEN 0.1 AND 16.7")
def filter_spatial(spark, sf):
    return shown(grid(spark, sf).filter_spatial(TRIANGLE))


DENSE = GRID + ", xs AS (SELECT DISTINCT x FROM g), ys AS (SELECT DISTINCT y FROM g), bs AS (SELECT DISTINCT bands FROM g), f AS (SELECT x, y, bands, coalesce(value, 0) AS value FROM xs CROSS JOIN ys CROSS JOIN bs LEFT JOIN g USING (x, y, bands)) "


@query(DENSE + "SELECT a.x, a.y, a.bands, round(sum(b.value * (CASE WHEN a.x = b.x AND a.y = b.y THEN 4 WHEN a.x = b.x OR a.y = b.y THEN 2 ELSE 1 END)) / 16, 6) AS value FROM f a JOIN f b ON a.bands = b.bands AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY ALL")
def apply_kernel(spark, sf):
    return shown(grid(spark, sf).densify().apply_kernel([[1, 2, 1], [2, 4, 2], [1, 2, 1]], factor=1 / 16))


@query(DENSE + "SELECT a.x, a.y, a.bands, round(sum(b.value), 6) AS value FROM f a JOIN f b ON a.bands = b.bands AND b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y WHERE a.x % 3 = 0 AND a.y % 2 = 0 GROUP BY ALL")
def apply_neighborhood(spark, sf):
    return shown(grid(spark, sf).densify().apply(lambda x: F.coalesce(x, F.lit(0.0))).apply_neighborhood(R._sum, {"x": 3, "y": 2}))


@query(DENSE + "SELECT floor(x / 2) * 2 + 0.5 AS x, floor(y / 3) * 3 + 1.0 AS y, bands, round(avg(value), 6) AS value FROM f GROUP BY ALL")
def resample_average(spark, sf):
    c = grid(spark, sf).densify().apply(lambda x: F.coalesce(x, F.lit(0.0)))
    return shown(c.resample_spatial(resolution=(2, 3), method="average"))


@query(DENSE + "SELECT CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, bands, round(value, 6) AS value FROM f WHERE x % 2 = 1 AND y % 3 = 1")
def resample_cube_spatial(spark, sf):
    c = grid(spark, sf).densify().apply(lambda x: F.coalesce(x, F.lit(0.0)))
    return shown(c.resample_cube_spatial(Cube(c.df.filter("x % 2 = 1 AND y % 3 = 1"), c.schema)))


@query(DENSE + ", t AS (SELECT x + 0.5 AS x, y AS y FROM xs CROSS JOIN ys WHERE x < (SELECT max(x) FROM xs)) SELECT t.x, t.y, f.bands, round(avg(f.value), 6) AS value FROM t JOIN f ON f.y = t.y AND abs(f.x - t.x) = 0.5 GROUP BY ALL")
def resample_bilinear(spark, sf):
    c = grid(spark, sf).densify().apply(lambda x: F.coalesce(x, F.lit(0.0)))
    top = c.df.agg(F.max("x")).first()[0]
    target = Cube(c.df.filter(F.col("x") < top).withColumn("x", F.col("x") + 0.5), c.schema)
    return shown(c.resample_cube_spatial(target, "bilinear"))


# Merging


@query("SELECT user_id, event_type AS bands, round(avg(value), 6) AS value FROM events GROUP BY ALL")
def merge_disjoint(spark, sf):
    c = events(spark, sf).reduce_dimension(R.mean, "t")
    return shown(c.filter_bands(["click", "error"]).merge_cubes(c.filter_bands(["purchase", "signup", "view"])))


@query(GRID + ", w AS (SELECT x, y, bands, value * 10 AS value FROM g WHERE bands <> 'A') SELECT x, y, bands, round(CASE WHEN g.value IS NULL THEN w.value WHEN w.value IS NULL THEN g.value ELSE (g.value + w.value) / 2 END, 6) AS value FROM (SELECT * FROM g WHERE bands <> 'R') g FULL JOIN w USING (x, y, bands)")
def merge_partial_overlap(spark, sf):
    c = grid(spark, sf)
    return shown(c.filter_bands(["A", "N"]).merge_cubes(c.filter_bands(["N", "R"]).apply(lambda x: x * 10), lambda x, y: (x + y) / 2))


@query(GRID + "SELECT 'cube1' AS __cubes__, x, y, bands, value FROM g UNION ALL SELECT 'cube2', x, y, bands, -value FROM g")
def merge_identical(spark, sf):
    c = grid(spark, sf)
    return shown(c.merge_cubes(c.apply(lambda x: -x)))


@query(GRID + "SELECT x, y, bands, round(value - sqrt(value), 6) AS value FROM g")
def merge_resolved(spark, sf):
    c = grid(spark, sf)
    return shown(c.merge_cubes(c.apply(S.sqrt), S.subtract))


@query(GRID + ", m AS (SELECT x, y, max(value) AS m FROM g GROUP BY x, y) SELECT g.x, g.y, bands, round(value / m, 6) AS value FROM g JOIN m USING (x, y)")
def merge_broadcast(spark, sf):
    c = grid(spark, sf)
    return shown(c.merge_cubes(c.reduce_dimension(R._max, "bands"), S.divide))


# Indices

BANDS5 = GRID + ", p AS (SELECT x, y, max(value) FILTER (bands = 'A') AS a, max(value) FILTER (bands = 'N') AS n, max(value) FILTER (bands = 'R') AS r FROM g GROUP BY x, y) "


@query(BANDS5 + "SELECT x, y, round(CASE WHEN n + a <> 0 THEN (n - a) / (n + a) END, 6) AS value FROM p")
def ndvi(spark, sf):
    return shown(grid(spark, sf).ndvi(nir="N", red="A"))


@query(BANDS5 + "SELECT x, y, 'dc' AS bands, round((r - a) * 2.5, 6) AS value FROM p UNION ALL SELECT x, y, 'midcl', round((a - n) * 2.5, 6) FROM p UNION ALL SELECT x, y, 'lowcl', round((n - r) * 2.5, 6) FROM p")
def ddmc(spark, sf):
    return shown(grid(spark, sf).ddmc("A", "N", "R", "N", "A"))


# Scalars


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice / nullif(l_discount, 0), 4) AS divided, CAST(floor(l_tax * 100) AS DOUBLE) AS f, round(ln(l_quantity), 6) AS ln, round(log(l_quantity) / log(2), 6) AS lg, round(sin(l_tax), 6) AS sin, round(cos(l_tax), 6) AS cos,
round(tan(l_tax), 6) AS tan, round(asin(l_tax), 6) AS asin, round(acos(l_discount), 6) AS acos, round(atan2(l_tax, l_discount), 6) AS at2, round(sinh(l_tax), 6) AS sinh, round(sqrt(l_quantity), 6) AS sqrt, round(pow(l_tax, 2), 6) AS sq,
round_even(l_extendedprice / 1000, 0) AS rounded, round(l_quantity - 7 * floor(l_quantity / 7), 6) AS md, round((least(greatest(l_quantity, 10), 40) - 10) / 30, 6) AS scaled, round((l_tax - l_discount) / nullif(l_tax + l_discount, 0), 6) AS nd FROM lineitem""")
def scalar_math(spark, sf):
    q, d, t, p = (F.col(c) for c in ("l_quantity", "l_discount", "l_tax", "l_extendedprice"))
    part = F.when(d != 0, S.divide(p, d))
    return read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(part, 4).alias("divided"), S.floor(t * 100).alias("f"), r6(S.ln(q)).alias("ln"), r6(S.log(q, 2)).alias("lg"), r6(S.sin(t)).alias("sin"), r6(S.cos(t)).alias("cos"),
        r6(S.tan(t)).alias("tan"), r6(S.arcsin(t)).alias("asin"), r6(S.arccos(d)).alias("acos"), r6(S.arctan2(t, d)).alias("at2"), r6(S.sinh(t)).alias("sinh"), r6(S.sqrt(q)).alias("sqrt"), r6(S.power(t, 2)).alias("sq"),
        S._round(p / 1000).alias("rounded"), r6(S.mod(q, 7)).alias("md"), r6(S.linear_scale_range(q, 10, 40)).alias("scaled"), r6(S.normalized_difference(t, d)).alias("nd"),
    )


@query("""SELECT event_id, value > 50 AS gt, value BETWEEN 10 AND 20 AS inside, abs(value - 50) <= 5 + 1e-5 * 50 AS near, lower(event_type) = 'view' AS is_view, (value > 50) <> (user_id > 50) AS x, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS side,
(CASE WHEN user_id % 7 <> 0 THEN value > 50 END) AND (user_id > 50) AS both_hold, (CASE WHEN user_id % 7 <> 0 THEN value > 50 END) OR (user_id > 50) AS one_holds FROM events""")
def scalar_logic(spark, sf):
    v, u = F.col("value"), F.col("user_id")
    maybe = F.when(u % 7 != 0, v > 50)
    return read(spark, sf, "events").select(
        "event_id", S.gt(v, 50).alias("gt"), S.between(v, 10, 20).alias("inside"), S.eq(v, 50, delta=5).alias("near"), S.eq(F.col("event_type"), "VIEW", case_sensitive=False).alias("is_view"), S.xor(v > 50, u > 50).alias("x"),
        S._if(v > 50, "high", "low").alias("side"), S._and(maybe, u > 50).alias("both_hold"), S._or(maybe, u > 50).alias("one_holds"),
    )


@query("""SELECT p_partkey, starts_with(p_name, 'p') AS b, contains(lower(p_name), 'a') AS c, suffix(p_type, 'L') AS e, p_brand || '-' || CAST(p_size AS VARCHAR) || '-none' AS joined FROM part""")
def scalar_text(spark, sf):
    n = F.col("p_name")
    return read(spark, sf, "part").select("p_partkey", S.text_begins(n, "p").alias("b"), S.text_contains(n, "A", False).alias("c"), S.text_ends(F.col("p_type"), "L").alias("e"), S.text_concat([F.col("p_brand"), F.col("p_size"), None], "-").alias("joined"))


@query("""SELECT o_orderkey, CAST(epoch_us(TIMESTAMP '2000-01-01') - epoch_us(o_orderdate) AS DOUBLE) / 86400000000 AS days, CAST((2000 * 12 + 1) - (year(o_orderdate) * 12 + month(o_orderdate)) AS DOUBLE) AS months,
o_orderdate >= '1996-01-01' AND o_orderdate < '1997-01-01' AS in96, strftime(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH, '%Y-%m-%d') AS later FROM orders""")
def scalar_dates(spark, sf):
    d = F.col("o_orderdate")
    return read(spark, sf, "orders").select(
        "o_orderkey", S.date_difference(d, "2000-01-01", "day").alias("days"), S.date_difference(d, "2000-01-01", "month").alias("months"), S.date_between(d, "1996-01-01", "1997-01-01", exclude_max=True).alias("in96"), S.date_shift(F.date_format(d, "yyyy-MM-dd"), 1, "month").alias("later")
    )


# Arrays


@query("""SELECT vec_id, round(list_min(e), 6) AS low, round(list_max(e), 6) AS high, round(list_avg(e), 4) AS mean, round(list_median(e), 6) AS median, round(e[3], 6) AS third, len(e) AS n, coalesce(list_position(s, e[5]) - 1, 999999) AS at, len(list_filter(e, lambda x: x > 0)) AS positive,
round(list_sum(list_transform(e[1:4], lambda x: x * 2)), 5) AS doubled, round(s[2], 6) AS second_low FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, list_sort(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS s FROM embeddings)""")
def array_functions(spark, sf):
    rows = read(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    rows = rows.withColumn("s", A.sort(F.col("e")))
    e, s = F.col("e"), F.col("s")
    return rows.select(
        "vec_id", r6(A.array_min(e)).alias("low"), r6(A.array_max(e)).alias("high"), F.round(A.array_mean(e), 4).alias("mean"), r6(A.array_median(e)).alias("median"), r6(A.array_element(e, 2)).alias("third"), A.array_count(e).alias("n"),
        A.array_find(s, F.get(e, F.lit(4))).alias("at"), A.array_count(e, lambda x: x > 0).alias("positive"), F.round(A.array_sum(A.array_apply(F.slice(e, 1, 4), lambda x: x * 2)), 5).alias("doubled"), r6(F.get(A.rearrange(e, A.order(e)), F.lit(1))).alias("second_low"),
    )


@query("""SELECT vec_id, list_concat(e[1:2], [100.0::DOUBLE]) AS modified, list_concat(e[1:2], e[4:5]) AS joined, list_contains(e, e[1]) AS has, range(0, len(e))[1:3] AS labels FROM (SELECT vec_id, list_transform(embedding[1:5], lambda x: round(CAST(x AS DOUBLE), 6)) AS e FROM embeddings)""")
def array_edits(spark, sf):
    rows = read(spark, sf, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 5), lambda v: F.round(v.cast("double"), 6)).alias("e"))
    e = F.col("e")
    return rows.select(
        "vec_id", A.array_modify(e, F.array(F.lit(100.0)), 2, 3).alias("modified"), A.array_concat(F.slice(e, 1, 2), F.slice(e, 4, 2)).alias("joined"), A.array_contains(e, F.get(e, F.lit(0))).alias("has"), F.slice(A.array_labels(e), 1, 3).cast("array<bigint>").alias("labels")
    )


# Models, user code and graphs


@query("SELECT l_returnflag AS bands, 'param_0' AS param, round(regr_intercept(v, s), 1) AS value FROM (SELECT l_returnflag, l_linenumber AS s, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL) GROUP BY 1 UNION ALL SELECT l_returnflag, 'param_1', round(regr_slope(v, s), 1) FROM (SELECT l_returnflag, l_linenumber AS s, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL) GROUP BY 1")
def fit_curve(spark, sf):
    rows = read(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("bands"), F.col("l_linenumber").alias("s")).agg(F.avg("l_extendedprice").alias(VALUE))
    fit = Cube.of(rows, ["bands", "s"]).fit_curve([1.0, 1.0], lambda x, a, b: a + b * x, "s")
    return fit.df.select("bands", "param", F.round(VALUE, 1).alias(VALUE))


@query("SELECT event_type AS bands, s, round(min(value) + s * max(value), 6) AS value FROM events CROSS JOIN (VALUES (1.0::DOUBLE), (2.5::DOUBLE)) t(s) GROUP BY event_type, s")
def predict_curve(spark, sf):
    p = read(spark, sf, "events").groupBy(F.col("event_type").alias("bands")).agg(F.min("value").alias("param_0"), F.max("value").alias("param_1")).unpivot(["bands"], ["param_0", "param_1"], "param", VALUE)
    cube = Cube.of(p, ["bands", "param"])
    return shown(cube.predict_curve(lambda x, p: p[0] + p[1] * x, "s", [1.0, 2.5]))


@query()
def random_forest(spark, sf):
    rows = read(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_extendedprice", F.struct("l_orderkey", "l_linenumber").alias("k"))
    from gridloom.operators.models import fit_regr_random_forest

    model = fit_regr_random_forest(rows, None, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", num_trees=10)
    cells = read(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.first(c).alias(c) for c in ("l_quantity", "l_discount", "l_tax")]).unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "bands", VALUE)
    return Cube.of(cells, ["l_orderkey", "l_linenumber", "bands"], VALUE, ["l_quantity", "l_discount", "l_tax"]).predict_random_forest(model).df


@query(GRID + "SELECT x, y, bands, round(value * 3 + 1, 6) AS value FROM g")
def run_udf(spark, sf):
    return shown(grid(spark, sf).run_udf("def apply_datacube(cells, context):\n    return cells.assign(value=cells['value'] * 3 + context['add'])", context={"add": 1}))


@query()
def rqadeforestation(spark, sf):
    e = read(spark, sf, "events").select(F.col("ts").alias("t"), "user_id", F.col("value").alias(VALUE))
    return shown(Cube.of(e, ["t", "user_id"]).rqa_trend("t", 10.0))


GRAPH = {
    "load": {"process_id": "filter_bands", "arguments": {"data": {"from_parameter": "cube"}, "bands": ["A", "N"]}},
    "scaled": {"process_id": "apply", "arguments": {"data": {"from_node": "load"}, "process": {"process_graph": {"m": {"process_id": "multiply", "arguments": {"x": {"from_parameter": "x"}, "y": 0.5}, "result": True}}}}},
    "mean": {"process_id": "reduce_dimension", "arguments": {"data": {"from_node": "scaled"}, "dimension": "bands", "reducer": {"process_graph": {"r": {"process_id": "mean", "arguments": {"data": {"from_parameter": "data"}}, "result": True}}}}, "result": True},
}


@query(GRID + "SELECT x, y, round(avg(value * 0.5), 6) AS value FROM g WHERE bands IN ('A', 'N') GROUP BY x, y")
def process_graph(spark, sf):
    return shown(Graph(GRAPH).result({"cube": grid(spark, sf)}))


from gridloom.plans import coverage  # noqa: E402, F401  registers its queries here as well
