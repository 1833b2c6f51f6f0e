"""Filters. Plain predicates on dimension columns, which Spark pushes into the scan."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from gridloom.errors import BandFilterParameterMissing, DimensionNotAvailable, LabelNotAvailable, TemporalExtentEmpty
from gridloom.functions.crs import reproject_bbox, same_crs
from gridloom.schema import VALUE, BBox, Interval

METHODS = ("filter_temporal", "filter_labels", "filter_bands", "filter_bbox", "filter_spatial")


def _cube(df, schema):
    from gridloom.cube import Cube

    return Cube(df, schema)


def filter_temporal(cube, extent, dimension: str | None = None):
    """start <= t < end; either end may be None."""
    dim = cube.schema.only("temporal", dimension)
    start, end = (extent.start, extent.end) if isinstance(extent, Interval) else extent
    if start is not None and end is not None and str(end) < str(start):
        raise TemporalExtentEmpty(f"{start} to {end}")
    t = F.col(dim.name)
    kind = cube.df.schema[dim.name].dataType.simpleString()
    df = cube.df.filter(t.isNotNull())
    if start is not None:
        df = df.filter(t >= F.lit(start).cast(kind))
    if end is not None:
        df = df.filter(t < F.lit(end).cast(kind))
    return _cube(df, cube.schema)


def filter_labels(cube, condition, dimension: str, context=None):
    """Keeps the labels for which condition(label) holds."""
    dim = cube.schema.dim(dimension)
    kept = cube.df.filter(condition(F.col(dimension)))
    if dim.labels is not None:
        table = cube.spark.createDataFrame([(x,) for x in dim.labels], [dimension])
        have = {r[0] for r in table.filter(condition(F.col(dimension))).collect()}
        return _cube(kept, cube.schema.put(replace(dim, labels=tuple(x for x in dim.labels if x in have))))
    return _cube(kept, cube.schema)


def filter_bands(cube, bands: list | None = None):
    """Keeps bands, in the order asked for; common names count as well."""
    if not bands:
        raise BandFilterParameterMissing
    dim = cube.schema.band
    common = {v: k for k, v in cube.schema.common_names.items()}
    known = dim.labels if dim.labels is not None else cube.labels(dim.name)
    names = [b if b in known else common.get(b, b) for b in bands]
    if missing := [b for b in names if b not in known]:
        raise LabelNotAvailable(missing)
    return _cube(cube.df.filter(F.col(dim.name).isin(names)), cube.schema.put(replace(dim, labels=tuple(names))))


def filter_bbox(cube, extent: BBox):
    """Cells whose labels lie in the box, borders included; the box is brought to the cube's system first."""
    dims = cube.schema.spatial
    if not dims:
        raise DimensionNotAvailable("no spatial dimension")
    box = extent if cube.schema.crs is None or same_crs(extent.crs, cube.schema.crs) else reproject_bbox(extent, cube.schema.crs)
    df = cube.df
    for d in dims:
        low, high = (box.west, box.east) if d.type == "x" else (box.south, box.north)
        df = df.filter(F.col(d.name).between(low, high))
    return _cube(df.select(*cube.dims, VALUE), cube.schema)


def filter_spatial(cube, geometries):
    """Cells inside the geometries; first by their common box."""
    from gridloom.functions.geometry import Shapes
    from gridloom.operators.masks import mask_polygon

    shapes = Shapes.of(geometries, cube.schema.crs)
    west, south, east, north = shapes.bounds
    return mask_polygon(filter_bbox(cube, BBox(west, south, east, north, cube.schema.crs or shapes.crs)), shapes)
