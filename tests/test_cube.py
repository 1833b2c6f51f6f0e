from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import errors as E
from gridloom.cube import Cube
from gridloom.functions import crs as C
from gridloom.functions import reducers as R
from gridloom.functions.geometry import buffered
from gridloom.operators.aggregate import period_intervals
from gridloom.plans.registry import processes
from gridloom.schema import VALUE, BBox, guess_type


def full(spark, nx, ny, value=1.0):
    df = spark.range(nx).select(F.col("id").cast("double").alias("x")).crossJoin(spark.range(ny).select(F.col("id").cast("double").alias("y"))).withColumn(VALUE, F.lit(value))
    return Cube.of(df, ["x", "y"], crs="EPSG:3857")


def random_cube(spark, shape=(4, 3, 5, 2)):
    data = np.random.default_rng(42).integers(-100, 100, shape).astype(float)
    rows = [(float(i), float(j), datetime(2018, 5, 1 + k), ["B02", "B03", "B04", "B08"][b], float(data[i, j, k, b])) for i in range(shape[0]) for j in range(shape[1]) for k in range(shape[2]) for b in range(shape[3])]
    df = spark.createDataFrame(rows, "x double, y double, t timestamp_ntz, bands string, value double")
    return Cube.of(df, ["x", "y", "t", "bands"], VALUE, ["B02", "B03", "B04", "B08"][: shape[3]], "EPSG:4326"), data


def grid(cube):
    rows = {(r["x"], r["y"]): r[VALUE] for r in cube.df.collect()}
    xs, ys = sorted({k[0] for k in rows}), sorted({k[1] for k in rows})
    return [[rows.get((x, y)) for y in ys] for x in xs]


@pytest.mark.parametrize(
    "shape, size, overlap, expected",
    [
        ((5, 5), {"x": 2, "y": 2}, None, [[1, 2, 2], [2, 4, 4], [2, 4, 4]]),
        ((4, 4), {"x": 2, "y": 2}, None, [[1, 2], [2, 4]]),
        ((4, 4), {"x": 1, "y": 1}, {"x": 1, "y": 1}, [[4, 6], [6, 9]]),
        ((5, 5), {"x": 1, "y": 2}, None, [[1, 2, 2]] * 5),
        ((4, 4), {"x": 1, "y": 1}, {"x": 1, "y": 2}, [[6, 6], [9, 9]]),
        ((4, 4), {"x": -1, "y": -1}, {"x": 2, "y": 2}, [[4, 6, 6, 4], [6, 9, 9, 6], [6, 9, 9, 6], [4, 6, 6, 4]]),
    ],
)
def test_neighborhood(spark, shape, size, overlap, expected):
    assert grid(full(spark, *shape).apply_neighborhood(R._sum, size, overlap)) == expected


@pytest.mark.parametrize("border", [0, 5, "replicate", "reflect", "reflect_pixel", "wrap"])
def test_kernel_against_numpy(spark, border):
    data = np.random.default_rng(1).integers(-9, 9, (5, 4)).astype(float)
    df = spark.createDataFrame([(float(i), float(j), float(data[i, j])) for i in range(5) for j in range(4)], "x double, y double, value double")
    kernel = np.array([[1.0, 2, 3], [4, 5, 6], [7, 8, 9]])
    mode = {"replicate": "edge", "reflect": "symmetric", "reflect_pixel": "reflect", "wrap": "wrap"}
    padded = np.pad(data, 1, mode[border]) if isinstance(border, str) else np.pad(data, 1, constant_values=border)
    want = [[float((padded[i : i + 3, j : j + 3] * kernel[::-1, ::-1]).sum() * 0.5) for j in range(4)] for i in range(5)]
    got = grid(Cube.of(df, ["x", "y"]).apply_kernel(kernel.tolist(), 0.5, border))
    assert np.allclose(got, want)


def test_kernel_must_be_odd(spark):
    with pytest.raises(E.KernelDimensionsUneven):
        full(spark, 3, 3).apply_kernel([[1, 1], [1, 1]])


def test_reduce_matches_numpy(spark):
    cube, data = random_cube(spark)
    got = {(r.x, r.y, r.bands): r.value for r in cube.reduce_dimension(R.mean, "t").df.collect()}
    assert np.allclose([got[i, j, b] for i in range(4) for j in range(3) for b in ("B02", "B03")], data.mean(2).ravel())
    assert np.isclose(cube.reduce_spatial(R.sd).filter_bands(["B03"]).df.filter("day(t) = 2").first().value, data[:, :, 1, 1].std(ddof=1))
    first = cube.reduce_dimension(R.first, "t").df.filter("x = 1 AND y = 2 AND bands = 'B02'").first().value
    assert first == data[1, 2, 0, 0]


def test_null_reducers(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, None), ("b", 1, 3.0), ("b", 2, float("nan"))], "k string, i int, value double")
    cube = Cube.of(df, ["k", "i"])
    got = {n: {r.k: r.value for r in cube.reduce_dimension(f, "i").df.collect()} for n, f in (("sum", R._sum), ("product", R.product), ("mean", R.mean), ("count", R.count), ("first", R.first))}
    assert got == {"sum": {"a": 0, "b": 3}, "product": {"a": 1, "b": 3}, "mean": {"a": None, "b": 3}, "count": {"a": 0, "b": 1}, "first": {"a": None, "b": 3}}
    strict = {r.k: r.value for r in cube.reduce_dimension(lambda d: R.mean(d, ignore_nodata=False), "i").df.collect()}
    assert strict == {"a": None, "b": None}
    kleene = {r.k: r.value for r in cube.reduce_dimension(lambda d: R._any(d, ignore_nodata=False), "i").df.collect()}
    assert kleene == {"a": None, "b": True}


@pytest.mark.parametrize(
    "low, high, period, count",
    [
        ((2018, 5, 1), (2018, 8, 31), "dekad", 12), ((2018, 5, 15), (2018, 8, 14), "dekad", 10), ((2018, 5, 1), (2019, 4, 30), "tropical-season", 2), ((2019, 1, 1), (2022, 12, 31), "decade", 2), ((2019, 1, 1), (2022, 12, 31), "decade-ad", 2),
    ],
)
def test_period_intervals(low, high, period, count):
    spans, labels = period_intervals(datetime(*low), datetime(*high), period)
    assert len(spans) == len(labels) == count and spans[0][0] <= datetime(*low) and spans[-1][1] >= datetime(*high)


@pytest.mark.parametrize("start, end, period, count", [("2018-05-01", "2018-05-02", "hour", 25), ("2018-05-01", "2018-06-01", "day", 32), ("2018-05-01", "2018-06-01", "week", 5), ("2018-05-01", "2018-06-01", "month", 2), ("2018-01-01", "2018-12-31", "season", 5), ("2018-01-01", "2018-12-31", "year", 1)])
def test_period_labels(spark, start, end, period, count):
    df = spark.createDataFrame([(start, 1.0), (end, 2.0)], "t string, value double").withColumn("t", F.col("t").cast("timestamp_ntz"))
    assert Cube.of(df, ["t"]).aggregate_temporal_period(R.mean, period).df.count() == count


def test_interval_edges(spark):
    df = spark.createDataFrame([("2020-01-01", 1.0), ("2020-01-05", 2.0), ("2020-01-09", 4.0)], "t string, value double").withColumn("t", F.col("t").cast("timestamp_ntz"))
    cube, spans = Cube.of(df, ["t"]), [("2020-01-01", "2020-01-05"), ("2020-01-05", "2020-01-10"), ("2021-01-01", "2021-02-01")]
    right = [r.value for r in cube.aggregate_temporal(spans, R._sum).df.orderBy("t").collect()]
    left = [r.value for r in cube.aggregate_temporal(spans, R._sum, closed="left").df.orderBy("t").collect()]
    assert right == [2, 4, None] and left == [1, 6, None]
    many = [(f"2020-01-{d:02d}", f"2020-01-{d + 1:02d}") for d in range(1, 25)]
    assert {r.t[:10]: r.value for r in cube.aggregate_temporal(many, R._sum).df.filter("value IS NOT NULL").collect()} == {"2020-01-04": 2, "2020-01-08": 4}
    with pytest.raises(NotImplementedError):
        cube.aggregate_temporal([("2020-01-01", "2020-01-05"), ("2020-01-03", "2020-01-10")], R._sum)


def test_dimensions(spark):
    cube, _ = random_cube(spark)
    assert guess_type("Longitude") == "x" and guess_type("T") == "temporal" and guess_type("foo") == "other"
    wide = cube.add_dimension("other", "l1", "other")
    assert wide.dims[0] == "other" and wide.drop_dimension("other").dims == cube.dims
    with pytest.raises(E.DimensionExists):
        wide.add_dimension("other", "l1")
    with pytest.raises(E.DimensionLabelCountMismatch):
        cube.drop_dimension("t")
    with pytest.raises(E.DimensionNotAvailable):
        cube.drop_dimension("nope")
    assert cube.rename_labels("bands", ["red"], ["B02"]).labels("bands") == ["red", "B03"]
    for args, error in ((("bands", ["a"], ["nope"]), E.LabelNotAvailable), (("bands", ["a", "b"], ["B02"]), E.LabelMismatch), (("bands", ["B03"], ["B02"]), E.LabelExists), (("bands", ["a"]), E.LabelsNotEnumerated)):
        with pytest.raises(error):
            cube.rename_labels(*args)
    assert cube.dimension_labels("t")[0] == "2018-05-01T00:00:00"
    typed = cube.rename_dimension("t", "when").add_dim_type("when", "temporal").filter_bands(["B03"])
    assert typed.filter_temporal(("2018-05-02", "2018-05-04")).df.select("when").distinct().count() == 2


def test_filters(spark):
    cube, _ = random_cube(spark)
    assert cube.filter_temporal((None, "2018-05-03")).df.select("t").distinct().count() == 2
    with pytest.raises(E.TemporalExtentEmpty):
        cube.filter_temporal(("2018-05-03", "2018-05-01"))
    assert cube.filter_bands(["B03", "B02"]).labels("bands") == ["B03", "B02"]
    with pytest.raises(E.BandFilterParameterMissing):
        cube.filter_bands()
    with pytest.raises(E.DimensionMissing):
        cube.reduce_dimension(R.mean, "bands").filter_bands(["B02"])
    assert cube.filter_bbox(BBox(1, 0, 2, 1)).df.select("x", "y").distinct().count() == 4
    assert cube.filter_labels(lambda x: x != "B02", "bands").labels("bands") == ["B03"]
    with pytest.raises(E.DimensionNotAvailable):
        cube.reduce_spatial(R.mean).filter_bbox(BBox(0, 0, 1, 1))


def test_merge_errors(spark):
    cube, _ = random_cube(spark)
    shifted = cube.filter_bands(["B02"])
    with pytest.raises(E.OverlapResolverMissing):
        cube.merge_cubes(shifted)
    with pytest.raises(E.OverlapResolverMissing):
        cube.merge_cubes(cube.reduce_dimension(R.mean, "t"))
    with pytest.raises(ValueError):
        cube.merge_cubes(cube.reduce_spatial(R.mean).reduce_dimension(R.mean, "t"), lambda x, y: x)
    moved = Cube(cube.df.withColumn("x", F.col("x") + 1e-8), cube.schema)
    both = cube.merge_cubes(moved, lambda x, y: x - y).df
    assert both.count() == cube.df.count() and both.filter("value != 0").count() == 0


def test_ndvi(spark):
    cube, data = random_cube(spark)
    with pytest.raises(E.NirBandAmbiguous):
        cube.ndvi(red="B02")
    with pytest.raises(E.RedBandAmbiguous):
        cube.ndvi(nir="B02")
    with pytest.raises(E.BandExists):
        cube.ndvi("B03", "B02", target_band="t")
    with pytest.raises(E.DimensionAmbiguous):
        cube.reduce_dimension(R.mean, "bands").ndvi()
    more = cube.ndvi("B03", "B02", target_band="ndvi")
    assert more.labels("bands") == ["B02", "B03", "ndvi"] and more.df.count() == cube.df.count() * 3 // 2


def test_masks(spark):
    square = {"type": "Polygon", "coordinates": [[[0.5, 0.5], [2.5, 0.5], [2.5, 2.5], [0.5, 2.5], [0.5, 0.5]], [[0.9, 0.9], [1.1, 0.9], [1.1, 1.1], [0.9, 1.1], [0.9, 0.9]]], "crs": 3857}
    cube = full(spark, 4, 4)
    assert cube.mask_polygon(square).df.filter("value IS NOT NULL").count() == 3  # the hole counts
    assert cube.mask_polygon(square, 0.0, inside=False).df.filter("value = 1").count() == 13
    overlapping = {"type": "FeatureCollection", "crs": 3857, "features": [{"type": "Feature", "properties": {}, "geometry": square}] * 2}
    with pytest.raises(E.GeometriesOverlap):
        cube.apply_polygon(overlapping, lambda x: x)
    some = Cube(cube.df.filter("x = 0").withColumn(VALUE, F.lit(1.0)), cube.schema)
    assert cube.mask(some, 7.0).df.filter("value = 7").count() == 4


def test_projections():
    for crs, lon, lat in ((32632, 10.5, 46.1), (32733, 17.0, -33.9), (3857, -120.0, 50.0)):
        x, y = C.from_degrees(lon, lat, crs)
        assert np.allclose(C.to_degrees(x, y, crs), (lon, lat), atol=1e-9)
    assert np.allclose(C.from_degrees(9.0, 0.0, 32632), (500000, 0)) and np.allclose(C.from_degrees(180.0, 0.0, 3857), (20037508.342789244, 0), atol=1e-6)
    assert C.code("urn:ogc:def:crs:OGC:1.3:CRS84") == 4326 and C.code("urn:ogc:def:crs:EPSG::32632") == 32632
    area = lambda r: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:])) / 2)
    assert np.isclose(area(buffered([[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]], 1)[0]), 16 + 16 + np.pi, atol=0.02)


def test_resample_reprojects(spark):
    df = spark.range(20).crossJoin(spark.range(20).withColumnRenamed("id", "j")).select((F.col("id") * 0.1 + 9).alias("x"), (F.col("j") * 0.1 + 46).alias("y"), (F.col("id") + F.col("j")).cast("double").alias(VALUE))
    cube = Cube.of(df, ["x", "y"], crs="EPSG:4326")
    out = cube.resample_spatial(32632, 10000, "bilinear")
    assert out.schema.crs == 32632 and out.df.filter("value IS NOT NULL").count() > 200
    row = out.df.filter("value IS NOT NULL").orderBy(F.abs(F.col("x") - 560000) + F.abs(F.col("y") - 5160000)).first()
    lon, lat = C.to_degrees(row.x, row.y, 32632)
    assert abs(row.value - ((lon - 9) / 0.1 + (lat - 46) / 0.1)) < 0.05
    for method in ("near", "cubic", "cubicspline", "lanczos", "average", "mode", "max", "min", "med", "q1", "q3"):
        assert cube.resample_spatial(resolution=0.2, method=method).df.filter("value IS NOT NULL").count() > 50
    with pytest.raises(E.DimensionMissing):
        Cube.of(df.select("x", VALUE), ["x"]).resample_spatial()


def test_curves(spark):
    rows = [(k, float(i), float(k * 1.5 + 2.0 * np.cos(0.3 * i) + k * np.sin(0.3 * i))) for k in range(3) for i in range(40)]
    cube = Cube.of(spark.createDataFrame(rows, "k int, s double, value double"), ["k", "s"])
    fit = cube.fit_curve([1.0, 1.0, 1.0], lambda x, a, b, c: a + b * np.cos(0.3 * x) + c * np.sin(0.3 * x), "s")
    got = {(r.k, r.param): r.value for r in fit.df.collect()}
    assert np.allclose([got[2, f"param_{i}"] for i in range(3)], [3.0, 2.0, 2.0], atol=1e-5)
    back = fit.predict_curve(lambda x, p: p[0] + p[1] * F.cos(x * 0.3) + p[2] * F.sin(x * 0.3), "s", [0.0, 5.0])
    assert np.isclose({(r.k, r.s): r.value for r in back.df.collect()}[1, 5.0], 1.5 + 2 * np.cos(1.5) + np.sin(1.5), atol=1e-4)


def test_all_processes_are_there():
    assert len(processes()) >= 137 and {"min", "and", "if", "round", "load_stac", "fit_curve", "rqadeforestation"} <= set(processes())


def test_mask_grids_and_times(spark):
    cube, data = random_cube(spark, (4, 4, 3, 1))
    moved = Cube(cube.df.select((F.col("x") + 0.25).alias("x"), (F.col("y") + 0.25).alias("y"), "t", "bands", F.lit(1.0).alias(VALUE)), cube.schema)
    assert cube.mask(moved, -7.0).df.filter("value = -7").count() == cube.df.count()  # a quarter of a cell aside: every cell is masked
    coarse = spark.createDataFrame([(float(x), float(y), float(x == 0)) for x in (0, 2) for y in (0, 2)], "x double, y double, value double")
    got = {r.x for r in cube.mask(Cube.of(coarse, ["x", "y"], crs="EPSG:4326"), -7.0).df.filter("value = -7").collect()}
    assert got == {0.0}
    times = [r.t for r in cube.df.select("t").distinct().orderBy("t").collect()]
    one = Cube(moved.df.filter(F.col("t") == times[0]), moved.schema)
    assert cube.mask(one, -7.0).df.filter("value = -7").count() == cube.df.count()  # one time holds for all
    two = Cube(cube.df.filter(F.col("t") != times[0]), cube.schema)
    with pytest.raises(E.DimensionLabelCountMismatch):
        cube.mask(two)
    other = Cube(cube.df.withColumn("t", F.col("t") + F.expr("INTERVAL 1 HOUR")), cube.schema)
    with pytest.raises(E.LabelMismatch):
        cube.mask(other)


def test_labelled_array_modify(spark):
    from gridloom.functions import arrays as A

    named = A.array_create_labeled(F.array(F.lit(1.0), F.lit(2.0)), ["a", "b"])
    new = A.array_create_labeled(F.array(F.lit(9.0)), ["b"])
    row = spark.range(1).select(A.array_modify(named, new, 1, 1, labeled=True).alias("v")).first().v
    assert [(r.label, r.value) for r in row] == [("a", 1.0), ("b", 9.0)]
    with pytest.raises(Exception, match="ArrayLabelConflict"):
        spark.range(1).select(A.array_modify(named, new, 0, 1, labeled=True).alias("v")).collect()


def test_forest_against_its_trees(spark):
    """Predictions are the mean over the trees of the value of the leaf that a cell falls into, walked by hand."""
    rng = np.random.default_rng(5)
    rows = [(float(a), float(b), float(3 * a - b * b + rng.normal())) for a, b in rng.uniform(-2, 2, (300, 2))]
    from gridloom.operators.models import fit_regr_random_forest

    model = fit_regr_random_forest(spark.createDataFrame(rows, "B02 double, B03 double, yield double"), None, ["B02", "B03"], "yield", num_trees=7)
    cells = [(float(i), b, v) for i, r in enumerate(rows[:40]) for b, v in zip(("B02", "B03"), r)]
    cube = Cube.of(spark.createDataFrame(cells, "x double, bands string, value double"), ["x", "bands"], VALUE, ["B02", "B03"])
    got = {r.x: r.value for r in cube.predict_random_forest(model).df.collect()}

    def leaf(node, point):
        while node.numDescendants():
            split = node.split()
            node = node.leftChild() if point[split.featureIndex()] <= split.threshold() else node.rightChild()
        return node.prediction()

    trees = [t.rootNode() for t in model.stages[1]._java_obj.trees()]
    for i, r in enumerate(rows[:40]):
        assert got[float(i)] == pytest.approx(sum(leaf(t, r) for t in trees) / len(trees))
    error = np.mean([(got[float(i)] - r[2]) ** 2 for i, r in enumerate(rows[:40])])
    assert error < 0.5 * np.var([r[2] for r in rows[:40]])


def test_recurrence_trend_against_its_matrix():
    from gridloom.operators.models import trend_of_recurrence

    for seed in range(5):
        y = np.random.default_rng(seed).normal(size=40).cumsum()
        near = np.abs(y[:, None] - y[None, :]) <= 1.5
        rates = [np.mean(np.diagonal(near, k)) for k in range(1, 30)]
        slope = np.polyfit(np.arange(1, 30), rates, 1)[0]
        assert trend_of_recurrence(y, 1.5) == pytest.approx(1000 * slope)
    assert np.isnan(trend_of_recurrence(np.zeros(3), 1.0))


@pytest.mark.parametrize("code", [2154, 3034, 3035, 25832])
def test_conic_and_equal_area_systems(spark, code):
    from gridloom.functions.projection import transform

    places = [(5.0, 50.0), (10.0, 52.0), (3.0, 44.0), (-4.0, 36.0), (25.0, 65.0)]
    df = spark.createDataFrame(places, "lon double, lat double")
    x, y = transform(F.col("lon"), F.col("lat"), 4326, code)
    moved = df.select("lon", "lat", x.alias("x"), y.alias("y"))
    back = transform(F.col("x"), F.col("y"), code, 4326)
    for r in moved.select("*", back[0].alias("lon2"), back[1].alias("lat2")).collect():
        assert (r.x, r.y) == pytest.approx(C.from_degrees(r.lon, r.lat, code)) and (r.lon2, r.lat2) == pytest.approx((r.lon, r.lat), abs=5e-8)
    if code == 3035:  # a published point of this system
        assert C.from_degrees(5.0, 50.0, code) == pytest.approx((3962799.45, 2999718.85), abs=0.01)
