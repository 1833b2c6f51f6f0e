"""Masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.errors import DimensionLabelCountMismatch, DimensionMismatch, DimensionNotAvailable, LabelMismatch
from gridloom.functions.geometry import EDGE, FEW_EDGES, Shapes, covering, inside_fixed
from gridloom.schema import VALUE

METHODS = ("mask", "mask_polygon")


def mask(cube, mask, replacement=None):
    """Where the mask is true, cells become the replacement; where it is NULL or has no cell, they stay.

    The mask may lack dimensions (bands, time): it then holds for all their labels. A mask on another grid is brought to that of the
    cube by its nearest cells; labels of time must be the same, unless the mask has one only, which then holds for all.
    """
    names = {d.name for d in cube.schema.dims}
    if extra := [d.name for d in mask.schema.dims if d.name not in names]:
        raise DimensionMismatch(f"only in the mask: {extra}")
    if [d.name for d in mask.schema.spatial] != [d.name for d in cube.schema.spatial] and mask.schema.spatial:
        raise DimensionMismatch("spatial dimensions differ")
    mask = _on_grid_of(cube, _at_times_of(cube, mask))
    hit = mask.df.filter(F.col(VALUE).cast("boolean")).select(*mask.dims, F.lit(True).alias("_hit"))
    joined = cube.df.join(hit, mask.dims, "left")
    kind = cube.df.schema[VALUE].dataType
    value = F.when(F.col("_hit"), F.lit(replacement).cast(kind)).otherwise(F.col(VALUE))
    return type(cube)(joined.select(*cube.dims, value.alias(VALUE)), cube.schema)


def _at_times_of(cube, mask):
    for d in mask.schema.of_type("temporal"):
        theirs, ours = mask.label_table(d.name), cube.label_table(d.name)
        n = mask.label_count(d.name, 1)
        if n == 1:
            if ours.join(theirs, d.name, "left_anti").isEmpty():
                continue
            return type(mask)(mask.df.drop(d.name), mask.schema.without(d.name))
        row = ours.withColumn("_a", F.lit(1)).join(theirs.withColumn("_b", F.lit(1)), d.name, "full").agg(F.count("_a"), F.count("_b"), F.count("*")).first()
        if row[0] != row[1]:
            raise DimensionLabelCountMismatch(f"{d.name}: {row[0]} labels, {row[1]} in the mask")
        if row[2] != row[0]:
            raise LabelMismatch(f"{d.name}: the mask has other labels")
    return mask


def _on_grid_of(cube, mask):
    """The mask with the spatial labels of the cube: as it is if it has them all, else resampled to the nearest cells."""
    spatial = [d.name for d in mask.schema.spatial]
    if not spatial or all(cube.label_table(d).join(mask.label_table(d), d, "left_anti").isEmpty() for d in spatial):
        return mask
    if len(spatial) < 2:
        raise DimensionMismatch("the labels of a spatial dimension differ")
    return mask.apply(lambda v: v.cast("double")).resample_cube_spatial(cube, "near").apply(lambda v: v == 1)


def covered(cube, shapes: Shapes):
    """The cube's rows with _in: whether a cell's centre lies in any of the shapes.

    For outlines of few edges, that is an expression over the spatial labels; else the distinct labels are joined with the edges.
    """
    dims = cube.schema.spatial
    if len(dims) < 2:
        raise DimensionNotAvailable("two spatial dimensions are needed")
    dx, dy = dims[0].name, dims[1].name
    edges = shapes.edges()
    if len(edges) > FEW_EDGES:
        hit = covering(cube.df, dx, dy, cube.spark.createDataFrame(edges, EDGE)).select(dx, dy, F.lit(True).alias("_in")).distinct()
        return cube.df.join(hit, [dx, dy], "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    x, y = F.col(dx), F.col(dy)
    out = F.lit(False)
    for shape in shapes.parts:
        own = F.lit(False)
        for poly in shape:
            part = inside_fixed(x, y, poly[0])
            for hole in poly[1:]:
                part = part & ~inside_fixed(x, y, hole)
            own = own | part
        out = out | own
    west, south, east, north = shapes.bounds
    return cube.df.withColumn("_in", x.between(west, east) & y.between(south, north) & out)


def mask_polygon(cube, mask, replacement=None, inside: bool = True):
    """Keeps cells inside the polygons (or outside of all with inside=False); the others become the replacement."""
    shapes = Shapes.of(mask, cube.schema.crs)
    kind = cube.df.schema[VALUE].dataType
    keep = F.col("_in") if inside else ~F.col("_in")
    rows = covered(cube, shapes)
    return type(cube)(rows.select(*cube.dims, F.when(keep, F.col(VALUE)).otherwise(F.lit(replacement).cast(kind)).alias(VALUE)), cube.schema)
