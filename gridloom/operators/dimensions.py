"""Dimensions and their labels."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.errors import DimensionExists, DimensionLabelCountMismatch, LabelExists, LabelMismatch, LabelNotAvailable, LabelsNotEnumerated
from gridloom.schema import VALUE, Dim, guess_type

METHODS = ("add_dimension", "drop_dimension", "rename_dimension", "rename_labels", "dimension_labels", "trim_cube", "add_dim_type", "inspect")


def _cube(df, schema):
    from gridloom.cube import Cube

    return Cube(df, schema)


def add_dimension(cube, name: str, label, type: str = "other"):
    """A dimension of one label, placed first."""
    if name in cube.dims:
        raise DimensionExists(name)
    kind = type if type != "spatial" else (k if (k := guess_type(name)) in ("x", "y") else "x")
    df = cube.df.select(F.lit(label).alias(name), *cube.dims, VALUE)
    return _cube(df, replace(cube.schema, dims=(Dim(name, kind, (label,)), *cube.schema.dims)))


def drop_dimension(cube, name: str):
    cube.schema.dim(name)
    if cube.label_count(name) > 1:
        raise DimensionLabelCountMismatch(f"{name} has more than one label")
    return _cube(cube.df.drop(name), cube.schema.without(name))


def rename_dimension(cube, source: str, target: str):
    old = cube.schema.dim(source)
    if target in cube.dims:
        raise DimensionExists(target)
    schema = replace(cube.schema, dims=tuple(replace(d, name=target) if d is old else d for d in cube.schema.dims))
    return _cube(cube.df.withColumnRenamed(source, target), schema)


def rename_labels(cube, dimension: str, target: list, source: list = ()):
    """With source, maps the i-th source label to the i-th target; without, replaces labels in order, which must be 0, 1, ... unless all are replaced."""
    dim = cube.schema.dim(dimension)
    now = cube.labels(dimension)
    if source:
        if len(source) != len(target):
            raise LabelMismatch(f"{len(source)} and {len(target)} labels")
        if missing := [s for s in source if s not in now]:
            raise LabelNotAvailable(missing)
    else:
        if len(target) > len(now):
            raise LabelMismatch(f"{len(target)} labels for {len(now)}")
        if len(target) < len(now) and 0 not in now:
            raise LabelsNotEnumerated(dimension)
        source = now[: len(target)]
    if clash := [t for t in target if t in now]:
        raise LabelExists(clash)
    swap = dict(zip(source, target))
    new = [swap.get(x, x) for x in now]
    kind = "string" if any(isinstance(x, str) for x in new) else None
    shown = F.col(dimension)
    out = shown.cast(kind) if kind else shown
    for s, t in swap.items():
        out = F.when(shown == F.lit(s), F.lit(t)).otherwise(out)
    df = cube.df.withColumn(dimension, out).select(*cube.dims, VALUE)
    fixed = tuple(str(x) for x in new) if kind else tuple(new)
    return _cube(df, cube.schema.put(replace(dim, labels=fixed if dim.labels is not None or len(new) <= 1000 else None)))


def dimension_labels(cube, dimension: str) -> list | DataFrame:
    """Labels in order; timestamps as ISO texts in UTC."""
    out = cube.labels(dimension)
    return [x.strftime("%Y-%m-%dT%H:%M:%S") + (f".{x.microsecond:06d}" if x.microsecond else "") if hasattr(x, "strftime") and hasattr(x, "hour") else x for x in out]


def trim_cube(cube):
    """Drops labels of temporal, band and other dimensions whose cells are all NULL."""
    df, schema = cube.df, cube.schema
    for d in schema.dims:
        if d.type in ("x", "y"):
            continue
        some = df.groupBy(d.name).agg(F.count(VALUE).alias("_n")).filter("_n > 0").select(d.name)
        if d.labels is not None:
            have = {r[0] for r in some.collect()}
            schema = schema.put(replace(d, labels=tuple(x for x in d.labels if x in have)))
        df = df.join(some, d.name, "left_semi")
    if df.isEmpty():
        raise ValueError("all cells are empty")
    return _cube(df.select(*cube.dims, VALUE), schema)


def add_dim_type(cube, name: str, type: str):
    kind = type if type != "spatial" else (k if (k := guess_type(name)) in ("x", "y") else "x")
    return _cube(cube.df, cube.schema.typed(name, kind))


def inspect(cube, message: str = "", code: str = "User", level: str = "info"):
    """Logs the schema and a few rows, and gives the cube back."""
    import logging

    logging.getLogger("gridloom").log(getattr(logging, level.upper()), "%s: %s %s %s.", code, message, cube.df.schema.simpleString(), cube.df.limit(5).collect())
    return cube
