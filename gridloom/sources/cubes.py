"""Cubes from and to storage."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridloom.cube import Cube
from gridloom.schema import VALUE, BBox, CubeSchema, Dim, schema_of

SCHEMA_FILE = "_gridloom.json"


def create_data_cube(spark: SparkSession) -> Cube:
    """A cube without dimensions and cells."""
    return Cube(spark.createDataFrame([], f"{VALUE} double"), CubeSchema(()))


def write_cube(cube: Cube, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Parquet, by default with a folder for each band, so a filter on bands reads those alone. The schema is a small JSON table beside it."""
    parts = partition_by if partition_by is not None else [d.name for d in cube.schema.of_type("bands")]
    cube.df.write.mode(mode).partitionBy(*parts).parquet(f"{path}/cells")
    about = {"dims": [asdict(d) for d in cube.schema.dims], "crs": cube.schema.crs, "attrs": cube.schema.attrs, "common_names": cube.schema.common_names}
    cube.spark.createDataFrame([(json.dumps(about, default=str),)], "schema string").coalesce(1).write.mode(mode).json(f"{path}/schema")


def read_cube(spark: SparkSession, path: str) -> Cube:
    about = json.loads(spark.read.json(f"{path}/schema").first()[0])
    dims = tuple(Dim(d["name"], d["type"], tuple(d["labels"]) if d["labels"] is not None else None) for d in about["dims"])
    df = spark.read.parquet(f"{path}/cells").select(*[d.name for d in dims], VALUE)
    return Cube(df, CubeSchema(dims, about["crs"], about["attrs"], about["common_names"]))


def read_parquet(spark: SparkSession, path: str, dims: list[str], value: str = VALUE, bands: list | None = None, crs=None) -> Cube:
    """A table with a column for each dimension and one of values."""
    return Cube.of(spark.read.parquet(path), dims, value, bands, crs)


def read_wide(spark: SparkSession, path: str, dims: list[str], bands: list[str], crs=None) -> Cube:
    """A table with a column for each band. Spark reads the columns of the bands that a query needs."""
    wide = spark.read.parquet(path)
    long = wide.select(*dims, *bands).unpivot(dims, bands, "bands", VALUE)
    return Cube.of(long, [*dims, "bands"], VALUE, bands, crs)


def clipped(cube: Cube, spatial_extent: BBox | None, temporal_extent, bands) -> Cube:
    if bands:
        cube = cube.filter_bands(bands)
    if spatial_extent is not None:
        cube = cube.filter_bbox(spatial_extent)
    if temporal_extent is not None:
        cube = cube.filter_temporal(temporal_extent)
    return cube


def as_time(cube: Cube, dim: str) -> Cube:
    """Text labels become timestamps."""
    return Cube(cube.df.withColumn(dim, F.to_timestamp_ntz(dim)), cube.schema)


__all__ = ["create_data_cube", "write_cube", "read_cube", "read_parquet", "read_wide", "clipped", "as_time", "schema_of"]
