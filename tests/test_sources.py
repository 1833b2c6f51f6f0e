import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom import errors as E
from gridloom.cube import Cube
from gridloom.functions import reducers as R
from gridloom.schema import VALUE, BBox
from gridloom.sources.cubes import create_data_cube, read_cube, read_wide, write_cube
from gridloom.sources.stac import kind_of, load_stac, parent_catalog, search_body
from gridloom.sources.vectors import load_geojson, load_url, load_vector_cube, vector_buffer, vector_reproject

POINTS = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"id": i, "name": f"p{i}"}, "geometry": {"type": "Point", "coordinates": [10 + i, 46]}} for i in range(5)]}


def test_cube_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1.0, "a", 5.0), (1.0, "b", None), (2.0, "a", 7.0)], "x double, bands string, value double")
    cube = Cube.of(df, ["x", "bands"], VALUE, ["b", "a"], "EPSG:4326")
    write_cube(cube, str(tmp_path / "c"))
    back = read_cube(spark, str(tmp_path / "c"))
    assert back.labels("bands") == ["b", "a"] and back.schema.crs == "EPSG:4326"
    assert sorted(map(tuple, back.df.collect()), key=str) == sorted(map(tuple, cube.df.collect()), key=str)
    assert "bands" in back.filter_bands(["a"]).df._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:60]
    df.groupBy("x").pivot("bands", ["a", "b"]).agg(F.max(VALUE)).write.parquet(str(tmp_path / "w"))
    assert read_wide(spark, str(tmp_path / "w"), ["x"], ["a", "b"]).df.count() == 4
    assert create_data_cube(spark).dims == [] and create_data_cube(spark).df.count() == 0


def test_vectors(spark, tmp_path):
    v = load_geojson(spark, POINTS)
    assert v.properties == ["id", "name"] and v.df.count() == 5
    assert {r.geom_id for r in v.filter_bbox(BBox(10.5, 45, 12.0, 47)).df.collect()} == {1, 2}
    cells = load_geojson(spark, POINTS, ["id"]).to_cube()
    assert cells.reduce_dimension(R._sum, "geometry").df.first().value == 10
    utm = vector_reproject(v, 32632)
    assert json.loads(utm.df.first().geometry)["coordinates"][0] > 500000
    assert {r.geom_id for r in utm.filter_bbox(BBox(10.5, 45, 12.0, 47)).df.collect()} == {1, 2}
    with pytest.raises(E.UnitMismatch):
        vector_buffer(v, 10)
    grown = json.loads(vector_buffer(utm, 100.0).df.first().geometry)["coordinates"][0][0]
    assert abs(max(x for x, _ in grown) - min(x for x, _ in grown) - 200) < 1e-6
    listed = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"v": [1, 2, 3]}, "geometry": None}]}
    assert load_geojson(spark, listed).to_cube().df.count() == 3
    path = tmp_path / "p.json"
    path.write_text(json.dumps(POINTS))
    assert load_url(spark, str(path), "GeoJSON").df.count() == 5 and load_url(spark, str(path), "JSON")["type"] == "FeatureCollection"
    with pytest.raises(E.FormatUnsuitable):
        load_url(spark, str(path), "GTiff")
    assert load_vector_cube(spark, geometries=POINTS).df.count() == 5
    with pytest.raises(E.CubeError):
        load_vector_cube(spark)


def item(tmp_path, name):
    return {
        "type": "Feature", "stac_version": "1.0.0", "id": name, "assets": {"data": {"href": f"{name}.zarr"}},
        "properties": {"cube:dimensions": {"t": {"type": "temporal"}, "x": {"type": "spatial", "axis": "x", "reference_system": 32632}, "y": {"type": "spatial", "axis": "y"}}, "cube:variables": {"B02": {"nodata": -1}, "B03": {}}},
    }


def reader(address, options):
    rows = [(float(i), 5.0, pd.Timestamp(f"2020-01-0{1 + address.startswith('two')}"), b, -1.0 if i == 0 else float(i)) for i in range(3) for b in ("B02", "B03")]
    yield pd.DataFrame(rows, columns=["x", "y", "t", "bands", "value"])


def test_stac(spark, tmp_path):
    docs = {
        "http://h/one": item(tmp_path, "one"), "http://h/cat/col": {"type": "Collection", "stac_version": "1.0.0", "id": "col"}, "http://h/cat": {"type": "Catalog", "stac_version": "1.0.0"}, "http://h/bad": {"type": "x"},
    }
    cube = load_stac(spark, "http://h/one", reader=reader, fetch=docs.__getitem__, bands=["B02"])
    assert cube.schema.crs == 32632 and [r.value for r in cube.df.orderBy("x").collect()] == [None, 1, 2]
    assert parent_catalog("http://h/cat/col", docs.__getitem__) == "http://h/cat"
    both = load_stac(spark, "http://h/cat/col", BBox(0, 0, 1.5, 9, 32632), ("2020-01-01", "2021-01-01"), reader=reader, fetch=docs.__getitem__, search=lambda url, body: [item(tmp_path, "one"), item(tmp_path, "two")])
    assert both.df.count() == 8
    with pytest.raises(NotImplementedError):
        load_stac(spark, "http://h/cat/col", fetch=docs.__getitem__)
    with pytest.raises(E.CubeError):
        kind_of(docs["http://h/bad"])
    with pytest.raises(E.LabelNotAvailable):
        load_stac(spark, "http://h/one", reader=reader, fetch=docs.__getitem__, bands=["B99"])
    assert search_body("c", BBox(1, 2, 3, 4), ("2020", None), None) == {"collections": ["c"], "bbox": [1, 2, 3, 4], "datetime": "2020/.."}


def test_streaming_equals_batch(spark, tmp_path):
    from gridloom.streaming.windows import sessions, windowed

    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type", "value").withColumn("ts", F.col("ts").cast("timestamp"))
    ev.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))
    for name, make in (("w", windowed), ("s", sessions)):
        out = make(stream, {"mean": R.mean, "n": R.count}, "ts", ["event_type"], "value")
        out.writeStream.format("memory").queryName(f"out_{name}").outputMode("append" if name == "s" else "complete").trigger(availableNow=True).start().awaitTermination()
        batch = make(ev, {"mean": R.mean, "n": R.count}, "ts", ["event_type"], "value")
        got = {(r.start, r.event_type): (round(r["mean"], 9), r.n) for r in spark.table(f"out_{name}").collect()}
        want = {(r.start, r.event_type): (round(r["mean"], 9), r.n) for r in batch.collect()}
        assert got and all(want[k] == v for k, v in got.items()) and (name == "s" or got == want)


def write_zarr(root, arrays, dims, codec):
    """A group of arrays in chunks, and its consolidated metadata; the last chunk of the first variable has no file."""
    import gzip
    import zlib

    import numpy as np

    meta = {".zgroup": {"zarr_format": 2}}
    pack = {"zlib": zlib.compress, "gzip": gzip.compress, None: bytes}[codec]
    for name, (data, chunks, attrs) in arrays.items():
        about = {"zarr_format": 2, "shape": list(data.shape), "chunks": list(chunks), "dtype": data.dtype.str, "compressor": {"id": codec} if codec else None, "fill_value": -99 if data.ndim > 1 else 0, "order": "C", "filters": None}
        (root / name).mkdir(parents=True)
        meta[f"{name}/.zarray"], meta[f"{name}/.zattrs"] = about, {"_ARRAY_DIMENSIONS": dims if data.ndim > 1 else [name], **attrs}
        (root / name / ".zarray").write_text(json.dumps(about))
        (root / name / ".zattrs").write_text(json.dumps(meta[f"{name}/.zattrs"]))
        many = [-(-s // c) for s, c in zip(data.shape, chunks)]
        for at in np.ndindex(*many):
            block = np.full(chunks, -99, data.dtype)
            part = data[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunks))]
            block[tuple(slice(0, s) for s in part.shape)] = part
            if not (name == "B02" and at == tuple(m - 1 for m in many)):
                (root / name / ".".join(map(str, at))).write_bytes(pack(block.tobytes()))
    (root / ".zmetadata").write_text(json.dumps({"metadata": meta, "zarr_consolidated_format": 1}))


@pytest.mark.parametrize("codec", ["zlib", "gzip", None])
def test_zarr(spark, tmp_path, codec):
    import numpy as np

    from gridloom.sources.zarr import read_zarr

    rng = np.random.default_rng(3)
    x, y, t = np.arange(5) * 10.0, np.arange(4) * 10.0, np.array([0, 1, 5], np.int64)
    data = {b: rng.integers(0, 100, (3, 4, 5)).astype("<i2") for b in ("B02", "B03")}
    data["B03"][0, 0, 0] = -99
    arrays = {"x": (x, (5,), {}), "y": (y, (3,), {}), "t": (t, (2,), {"units": "days since 2020-01-01"})} | {b: (v, (2, 3, 2), {}) for b, v in data.items()}
    write_zarr(tmp_path / "a.zarr", arrays, ["t", "y", "x"], codec)
    cube = read_zarr(spark, str(tmp_path / "a.zarr"), crs=32632)
    got = {(r.bands, r.t, r.y, r.x): r.value for r in cube.df.collect()}
    days = [pd.Timestamp("2020-01-01") + pd.Timedelta(days=int(d)) for d in t]
    want = {(b, days[i].to_pydatetime(), y[j], x[k]): float(v[i, j, k]) for b, v in data.items() for i in range(3) for j in range(4) for k in range(5) if v[i, j, k] != -99 and not (b == "B02" and i == 2 and j == 3 and k == 4)}
    assert got == want and cube.labels("bands") == ["B02", "B03"]
    some = read_zarr(spark, str(tmp_path / "a.zarr"), ["B03"], BBox(5, 0, 25, 15, 32632), ("2020-01-02", "2020-01-05"))
    assert {(r.bands, r.y, r.x, r.value) for r in some.df.collect()} == {("B03", y[j], x[k], float(data["B03"][1, j, k])) for j in (0, 1) for k in (1, 2)}
    one = item(tmp_path, "a") | {"assets": {"data": {"href": str(tmp_path / "a.zarr")}}}
    loaded = load_stac(spark, "i", BBox(5, 0, 25, 15, 32632), ("2020-01-02", "2020-01-05"), ["B03"], fetch=lambda url: one)
    assert loaded.df.count() == 4 and loaded.schema.crs == 32632
    with pytest.raises(E.LabelNotAvailable):
        read_zarr(spark, str(tmp_path / "a.zarr"), ["B99"])


def test_shapes_by_address_and_as_a_vector_cube(spark, tmp_path):
    import math

    from gridloom.functions import geometry as G

    ring = [[5 + 4 * math.cos(a / 150 * math.pi), 5 + 3 * math.sin(a / 150 * math.pi)] for a in range(300)]
    star = [[5 + (4 if k % 2 else 1.5) * math.cos(k / 100 * math.pi), 5 + (4 if k % 2 else 1.5) * math.sin(k / 100 * math.pi)] for k in range(200)]
    features = [{"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [[*r, r[0]]]}} for r in (ring, star)]
    features[0]["geometry"]["coordinates"].append([[4.2, 4.2], [5.9, 4.3], [5.1, 5.8], [4.2, 4.2]])  # a hole
    shapes = {"type": "FeatureCollection", "crs": {"properties": {"name": "EPSG:3857"}}, "features": features}
    df = spark.range(41).select((F.col("id") * 0.25).alias("x")).crossJoin(spark.range(41).select((F.col("id") * 0.25).alias("y"))).withColumn(VALUE, F.col("x") * 100 + F.col("y"))
    cube = Cube.of(df, ["x", "y"], VALUE, None, "EPSG:3857")
    cells = [(r.x, r.y, r.value) for r in df.collect()]
    own = G.Shapes.of(shapes)
    hit = [[v for x, y, v in cells if sum(G.contains(r, (x, y)) for p in shape for r in p) % 2] for shape in own.parts]
    assert len(own.edges()) > G.FEW_EDGES and all(hit)
    path = tmp_path / "s.json"
    path.write_text(json.dumps(shapes))
    for given in (shapes, str(path), load_geojson(spark, shapes)):
        got = {r.geometry: r.value for r in cube.aggregate_spatial(given, R._sum).df.collect()}
        assert all(abs(got[i] - sum(hit[i])) < 1e-6 for i in (0, 1))
    masked = {(r.x, r.y) for r in cube.mask_polygon(shapes).df.filter("value IS NOT NULL").collect()}
    inside = {v for h in hit for v in h}
    assert masked == {(x, y) for x, y, v in cells if v in inside}
