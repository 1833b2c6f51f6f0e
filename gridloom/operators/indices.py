"""Spectral indices: bands become columns by one conditional aggregation, so all of them cost one pass."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from gridloom.errors import BandExists, DimensionAmbiguous, LabelNotAvailable, NirBandAmbiguous, RedBandAmbiguous
from gridloom.functions.scalar import divide
from gridloom.schema import VALUE

METHODS = ("ndvi", "ddmc")


def _bands(cube, names: list[str]):
    band = cube.schema.band.name
    rest = cube.others(band)
    cells = cube.df.filter(F.col(band).isin(names))
    return cells.groupBy(*rest).agg(*[F.max(F.when(F.col(band) == n, F.col(VALUE).cast("double"))).alias(f"_b{i}") for i, n in enumerate(names)])


def _appended(cube, out, names: list[str]):
    dim = cube.schema.band
    both = cube.df.withColumn(VALUE, F.col(VALUE).cast("double")).unionByName(out.select(*cube.dims, VALUE))
    labels = None if dim.labels is None else (*dim.labels, *names)
    return type(cube)(both, cube.schema.put(replace(dim, labels=labels)))


def ndvi(cube, nir: str = "nir", red: str = "red", target_band: str | None = None):
    """(nir - red) / (nir + red); bands by label or common name. With target_band the index is one more band."""
    if len(cube.schema.of_type("bands")) != 1:
        raise DimensionAmbiguous("ndvi needs one band dimension")
    band = cube.schema.band
    known = cube.labels(band.name)
    if target_band is not None and (target_band in known or target_band in cube.dims):
        raise BandExists(target_band)
    common = {v: k for k, v in cube.schema.common_names.items()}

    def find(name, error):
        label = name if name in known else common.get(name)
        if label not in known:
            raise error(name)
        return label

    names = [find(nir, NirBandAmbiguous), find(red, RedBandAmbiguous)]
    wide = _bands(cube, names)
    index = divide(F.col("_b0") - F.col("_b1"), F.col("_b0") + F.col("_b1")).alias(VALUE)
    if target_band is None:
        return type(cube)(wide.select(*cube.others(band.name), index), cube.schema.without(band.name))
    return _appended(cube, wide.select(*cube.others(band.name), F.lit(target_band).alias(band.name), index), [target_band])


def ddmc(cube, nir08="nir08", nir09="nir09", cirrus="cirrus", swir16="swir16", swir22="swir22", gain: float = 2.5, target_band=None):
    """Differences of bands that show low, middle and deep clouds: bands dc, midcl and lowcl, or all under one more dimension label."""
    band = cube.schema.band
    known = cube.labels(band.name)
    common = {v: k for k, v in cube.schema.common_names.items()}
    names = []
    for n in (nir08, nir09, cirrus, swir16, swir22):
        label = n if n in known else common.get(n)
        if label not in known:
            raise LabelNotAvailable(n)
        names.append(label)
    a, b, c, d, e = (F.col(f"_b{i}") for i in range(5))
    parts = {"dc": (c - e) * gain, "midcl": (a - b) * gain, "lowcl": (d - c) * gain}
    made = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), v.alias("v")) for n, v in parts.items()])).alias("_x")
    out = _bands(cube, names).select(*cube.others(band.name), made)
    out = out.select(*cube.others(band.name), F.col("_x.n").alias(band.name), F.col("_x.v").alias(VALUE)).select(*cube.dims, VALUE)
    if target_band is not None:
        if set(parts) & set(known):
            raise BandExists(target_band)
        return _appended(cube, out, list(parts))
    return type(cube)(out, cube.schema.put(replace(band, labels=tuple(parts))))
