"""Vector cubes: one row a geometry, with its GeoJSON geometry, and properties as columns or as a dimension."""

from __future__ import annotations

import json
import urllib.request
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.cube import Cube
from gridloom.errors import CubeError, DimensionNotAvailable, FormatUnsuitable, UnitMismatch
from gridloom.functions import crs as C
from gridloom.functions.geometry import buffered, crs_of, polygons_of
from gridloom.schema import VALUE, BBox, CubeSchema, Dim

GEOMETRY = "geometry"


@dataclass(frozen=True)
class VectorCube:
    """df: geom_id, geometry (GeoJSON text), and a column for each property."""

    df: DataFrame
    crs: str | int = "EPSG:4326"

    @property
    def properties(self) -> list[str]:
        return [c for c in self.df.columns if c not in ("geom_id", GEOMETRY)]

    def to_cube(self, properties: list[str] | None = None) -> Cube:
        """(geometry x properties) cells as numbers; a single list-valued property gives a label for each element."""
        names = list(properties or self.properties)
        if len(names) == 1 and self.df.schema[names[0]].dataType.typeName() == "array":
            rows = self.df.select(F.col("geom_id").alias(GEOMETRY), F.posexplode(names[0]).alias("_i", VALUE))
            long = rows.select(GEOMETRY, F.concat(F.lit(f"{names[0]}_"), F.col("_i")).alias("properties"), F.col(VALUE).cast("double"))
            return Cube(long, CubeSchema((Dim(GEOMETRY, "other"), Dim("properties", "other")), self.crs))
        wide = self.df.select(F.col("geom_id").alias(GEOMETRY), *[F.col(n).cast("double").alias(n) for n in names])
        long = wide.unpivot([GEOMETRY], names, "properties", VALUE)
        return Cube(long, CubeSchema((Dim(GEOMETRY, "other"), Dim("properties", "other", tuple(names))), self.crs))

    def filter_bbox(self, extent: BBox) -> VectorCube:
        """Geometries that touch the box; empty ones fall away."""
        box = extent if C.same_crs(extent.crs, self.crs) else C.reproject_bbox(extent, self.crs)

        def touch(text):
            g = json.loads(text) if text else None
            if not g:
                return False
            if g["type"] == "Point":
                return bool(g["coordinates"]) and box.west <= g["coordinates"][0] <= box.east and box.south <= g["coordinates"][1] <= box.north
            for rings in polygons_of(g):
                if _meets(rings[0], box):
                    return True
            return False

        @F.pandas_udf("boolean")
        def touches(texts: pd.Series) -> pd.Series:
            return texts.map(touch).astype(bool)

        return VectorCube(self.df.filter(touches(GEOMETRY)), self.crs)

    def reproject(self, projection, dimension: str | None = None) -> VectorCube:
        if dimension not in (None, GEOMETRY):
            raise DimensionNotAvailable(dimension)
        source, target = self.crs, projection

        @F.pandas_udf("string")
        def moved(texts: pd.Series) -> pd.Series:
            return texts.map(lambda text: json.dumps(_mapped(json.loads(text), lambda p: list(C.transform(p[0], p[1], source, target)))), na_action="ignore")

        return VectorCube(self.df.withColumn(GEOMETRY, moved(GEOMETRY)), projection)

    def buffer(self, distance: float) -> VectorCube:
        """Grows points and polygons by a distance in the unit of the reference system, which must not be degrees."""
        if C.is_geographic(self.crs):
            raise UnitMismatch("a distance needs a projected reference system")

        def grow(text):
            g = json.loads(text)
            rings = [[[tuple(g["coordinates"])]]] if g["type"] == "Point" else polygons_of(g)
            return json.dumps({"type": "MultiPolygon", "coordinates": [buffered(p, distance) for p in rings]})

        @F.pandas_udf("string")
        def grown(texts: pd.Series) -> pd.Series:
            return texts.map(grow, na_action="ignore")

        return VectorCube(self.df.withColumn(GEOMETRY, grown(GEOMETRY)), self.crs)


def _meets(ring, box: BBox) -> bool:
    from gridloom.functions.geometry import contains, segments_cross

    corners = [(box.west, box.south), (box.east, box.south), (box.east, box.north), (box.west, box.north)]
    if any(box.west <= x <= box.east and box.south <= y <= box.north for x, y in ring) or any(contains(ring, c) for c in corners):
        return True
    return any(segments_cross(a, b, c, d) for a, b in zip(ring, ring[1:]) for c, d in zip(corners, [*corners[1:], corners[0]]))


def _mapped(g, move):
    if isinstance(g, dict):
        return {k: _mapped(v, move) if k in ("coordinates", "geometries", "geometry") else v for k, v in g.items()}
    if g and isinstance(g[0], (int, float)):
        return move(g)
    return [_mapped(x, move) for x in g]


def load_geojson(spark: SparkSession, data: dict | str, properties: list[str] = ()) -> VectorCube:
    """A feature collection, feature or polygon. Without properties, those of the first feature."""
    if isinstance(data, str):
        data = json.loads(data)
    features = data["features"] if data.get("type") == "FeatureCollection" else [data if data.get("type") == "Feature" else {"geometry": data, "properties": {}}]
    names = list(properties) or list((features[0].get("properties") or {}) if features else {})
    rows = []
    for i, f in enumerate(features):
        own = f.get("properties") or {}
        rows.append({"geom_id": i, GEOMETRY: json.dumps(f.get("geometry")), **{n: own.get(n) for n in names}})
    kinds = []
    for n in names:
        v = [r[n] for r in rows if r[n] is not None]
        kind = "boolean" if v and all(isinstance(x, bool) for x in v) else "double" if v and all(isinstance(x, (int, float)) for x in v) else "array<double>" if v and all(isinstance(x, list) for x in v) else "string"
        kinds.append(f"`{n}` {kind}")
        for r in rows:
            if r[n] is not None:
                r[n] = float(r[n]) if kind == "double" else [float(x) for x in r[n]] if kind == "array<double>" else r[n] if kind == "boolean" else str(r[n])
    schema = ", ".join(["geom_id long", f"{GEOMETRY} string", *kinds])
    return VectorCube(spark.createDataFrame([tuple(r[c] for c in ("geom_id", GEOMETRY, *names)) for r in rows], schema), crs_of(data))


def _fetched(url: str) -> bytes:
    if "://" not in url:
        with open(url, "rb") as f:
            return f.read()
    with urllib.request.urlopen(url) as answer:
        if answer.status >= 400:
            raise CubeError(f"{url}: status {answer.status}")
        return answer.read()


def load_url(spark: SparkSession, url: str, format: str, options=None):
    """GeoJSON as a vector cube, JSON as an object, Parquet (with GeoJSON or WKB geometries) as a vector cube."""
    if format.casefold() == "geojson":
        return load_geojson(spark, json.loads(_fetched(url)))
    if format.casefold() == "json":
        return json.loads(_fetched(url))
    if "parquet" in format.casefold():
        df = spark.read.parquet(url)
        column = next(c for c in df.columns if c in ("geometry", "geometries"))
        return VectorCube(df.withColumnRenamed(column, GEOMETRY).withColumn("geom_id", F.monotonically_increasing_id()))
    raise FormatUnsuitable(format)


def load_vector_cube(spark: SparkSession, URL: str | None = None, filename=None, geometries=None) -> VectorCube:
    """From a URL, inline JSON, or a GeoJSON object; one partition, as such tables are small."""
    data = geometries if geometries is not None else filename if filename is not None else json.loads(_fetched(URL)) if URL else None
    if data is None:
        raise CubeError("no geometries, URL or filename")
    found = load_geojson(spark, data)
    return VectorCube(found.df.coalesce(1), found.crs)


def vector_buffer(geometries: VectorCube, distance: float) -> VectorCube:
    return geometries.buffer(distance)


def vector_reproject(data: VectorCube, projection, dimension: str | None = None) -> VectorCube:
    return data.reproject(projection, dimension)
