"""Arrays in chunks (Zarr, format 2) as cubes: one task reads some chunk files, from any store that Spark reads.

Small metadata and the labels of the axes are read on the driver; chunks are read by Spark's own reader of binary files and decoded
where they are read. Chunks that lie outside of the wanted labels are not decoded, and variables that no band asks for are not read.
"""

from __future__ import annotations

import bz2
import gzip
import json
import lzma
import re
import zlib
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridloom.cube import Cube
from gridloom.errors import FormatUnsuitable, LabelNotAvailable, NoDataAvailable
from gridloom.schema import VALUE, BBox, CubeSchema, Dim, guess_type

#: Labels of an axis that the driver reads and executors get, at most.
AXIS = 20_000_000
# Microseconds of the units of time axes.
UNITS = {"nanoseconds": 1e-3, "microseconds": 1, "milliseconds": 1e3, "seconds": 1e6, "minutes": 60e6, "hours": 3600e6, "days": 86400e6}


def read_bytes(spark: SparkSession, path: str) -> bytes | None:
    """A small file of any store, whatever its name; None if there is none."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(at):
        return None
    stream = store.open(at)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def _json(spark: SparkSession, path: str) -> dict | None:
    data = read_bytes(spark, path)
    return None if data is None else json.loads(data)


def decoded(data: bytes, about: dict) -> np.ndarray:
    """The values of a chunk file, in the shape of a chunk."""
    codec = about.get("compressor") or {}
    kind = codec.get("id")
    if about.get("filters"):
        raise FormatUnsuitable("chunks with filters")
    if kind == "zlib":
        data = zlib.decompress(data)
    elif kind == "gzip":
        data = gzip.decompress(data)
    elif kind == "bz2":
        data = bz2.decompress(data)
    elif kind == "lzma":
        data = lzma.decompress(data)
    elif kind == "zstd":
        import zstandard

        data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
    elif kind is not None:
        raise FormatUnsuitable(f"chunks compressed by {kind}")
    return np.frombuffer(data, np.dtype(about["dtype"])).reshape(about["chunks"], order=about.get("order", "C"))


def whole_axis(spark: SparkSession, path: str) -> np.ndarray:
    """A one-dimensional array, such as the labels of an axis; times as datetime64."""
    about, attrs = _json(spark, f"{path}/.zarray"), _json(spark, f"{path}/.zattrs") or {}
    if about is None or len(about["shape"]) != 1 or about["shape"][0] > AXIS:
        raise FormatUnsuitable(f"{path} is no axis of {AXIS} labels at most")
    size, step = about["shape"][0], about["chunks"][0]
    out = np.full(size, about.get("fill_value") or 0, np.dtype(about["dtype"]))
    for k in range(-(-size // step)):
        data = read_bytes(spark, f"{path}/{k}")
        if data is not None:
            out[k * step : (k + 1) * step] = decoded(data, about)[: size - k * step]
    if m := re.match(r"(\w+) since (.+)", attrs.get("units", "")):
        if m[1] not in UNITS:
            raise FormatUnsuitable(attrs["units"])
        start = np.datetime64(datetime.fromisoformat(m[2].strip().replace("Z", "")), "us")
        return start + np.rint(out.astype(np.float64) * UNITS[m[1]]).astype("timedelta64[us]")
    return out.astype("datetime64[us]") if out.dtype.kind == "M" else out


def read_zarr(spark: SparkSession, path: str, bands: list[str] | None = None, spatial_extent: BBox | None = None, temporal_extent=None, crs=None, axes: dict[str, str] | None = None) -> Cube:
    """A cube over the variables of a group that share the dimensions of the first; axes: types of dimensions whose names don't tell.

    Cells that hold the fill value of their variable, or lie in a chunk without a file, are NULL and left out. Scale and offset
    are kept as attributes and not applied.
    """
    path = path.rstrip("/")
    group = _json(spark, f"{path}/.zmetadata")
    if group is not None:
        names = sorted({k.split("/")[0] for k in group["metadata"] if k.endswith("/.zarray")})
        about = {n: group["metadata"][f"{n}/.zarray"] for n in names}
        attrs = {n: group["metadata"].get(f"{n}/.zattrs", {}) for n in names}
    else:
        names = list(bands or [])
        about = {n: _json(spark, f"{path}/{n}/.zarray") for n in names}
        attrs = {n: _json(spark, f"{path}/{n}/.zattrs") or {} for n in names}
    variables = [n for n in names if about[n] is not None and len(about[n]["shape"]) > 1]
    if missing := [b for b in bands or [] if b not in variables]:
        raise LabelNotAvailable(missing)
    if not variables:
        raise NoDataAvailable(path)
    dims = attrs[variables[0]]["_ARRAY_DIMENSIONS"]
    wanted = [v for v in bands or variables if attrs[v]["_ARRAY_DIMENSIONS"] == dims]
    labels = {d: whole_axis(spark, f"{path}/{d}") for d in dims}
    kinds = {d: (axes or {}).get(d) or guess_type(d) for d in dims}
    keep = {d: np.ones(len(labels[d]), bool) for d in dims}
    for d in dims:
        if kinds[d] == "temporal" and temporal_extent is not None:
            low, high = temporal_extent
            keep[d] &= (labels[d] >= np.datetime64(low)) if low is not None else True
            keep[d] &= (labels[d] < np.datetime64(high)) if high is not None else True
        elif kinds[d] in ("x", "y") and spatial_extent is not None:
            a, b = (spatial_extent.west, spatial_extent.east) if kinds[d] == "x" else (spatial_extent.south, spatial_extent.north)
            keep[d] &= (labels[d] >= a) & (labels[d] <= b)
    chosen = {v: about[v] for v in wanted}

    def scan(frames):
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"]):
                for v, meta in chosen.items():
                    if m := re.search(rf"/{re.escape(v)}/([\d./]+)$", file):
                        break
                else:
                    continue
                at = [int(x) for x in re.split(r"[./]", m[1])]
                places = [np.arange(i * c, min((i + 1) * c, s)) for i, c, s in zip(at, meta["chunks"], meta["shape"])]
                inner = [np.flatnonzero(keep[d][p]) for d, p in zip(dims, places)]
                if any(not len(x) for x in inner):
                    continue
                values = decoded(content, meta)[np.ix_(*inner)].astype(np.float64).reshape(-1)
                fill = meta.get("fill_value")
                good = ~np.isnan(values) if fill is None or isinstance(fill, str) else ~np.isnan(values) & (values != fill)
                cols = {}
                for k, d in enumerate(dims):
                    axis = labels[d][places[k][inner[k]]]
                    shape = [1] * len(dims)
                    shape[k] = len(axis)
                    cols[d] = np.broadcast_to(axis.reshape(shape), [len(x) for x in inner]).reshape(-1)[good]
                yield pd.DataFrame({**cols, "bands": v, VALUE: values[good]})

    schema = ", ".join(f"`{d}` {'timestamp_ntz' if labels[d].dtype.kind == 'M' else 'double'}" for d in dims)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([f"{path}/{v}" for v in wanted]).select("path", "content")
    cells = files.mapInPandas(scan, f"{schema}, bands string, {VALUE} double")
    order = sorted(dims, key=lambda d: ("x", "y", "temporal").index(kinds[d]) if kinds[d] in ("x", "y", "temporal") else 9)
    known = CubeSchema((*[Dim(d, kinds[d]) for d in order], Dim("bands", "bands", tuple(wanted))), crs, {"scale": {v: attrs[v].get("scale_factor") for v in wanted if "scale_factor" in attrs[v]}})
    return Cube(cells.select(*order, F.col("bands"), VALUE), known)
