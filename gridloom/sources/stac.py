"""Catalogues of items: search, checks of assets and bands, and a scan whose partitions are assets of items.

Arrays in chunks and Parquet assets are read by Spark itself. Other pixels are decoded by a reader function of the caller, which gets an
asset's address and options and gives frames of cells, as no raster library is needed otherwise.
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridloom.cube import Cube
from gridloom.errors import CubeError, LabelNotAvailable, NoDataAvailable
from gridloom.schema import VALUE, BBox, CubeSchema, Dim
from gridloom.sources.cubes import clipped
from gridloom.sources.zarr import read_zarr


def fetch_json(url: str) -> dict:
    if "://" not in url:
        with open(url) as f:
            return json.load(f)
    with urllib.request.urlopen(url) as answer:
        return json.load(answer)


def kind_of(document: dict) -> str:
    """CATALOG, COLLECTION or ITEM."""
    kind = {"Feature": "ITEM", "Collection": "COLLECTION", "Catalog": "CATALOG"}.get(document.get("type"))
    if kind is None or "stac_version" not in document:
        raise CubeError("neither an item nor a collection")
    return kind


def parent_catalog(url: str, fetch: Callable[[str], dict] = fetch_json) -> str:
    """The nearest address above url that is a catalogue."""
    parts = urllib.parse.urlsplit(url)
    path = parts.path.rstrip("/")
    while "/" in path:
        path = path.rpartition("/")[0]
        above = urllib.parse.urlunsplit((parts.scheme, parts.netloc, path, "", ""))
        try:
            if kind_of(fetch(above)) == "CATALOG":
                return above
        except Exception:  # noqa: S112 - an address that isn't a catalogue; look further up
            continue
    raise CubeError(f"no catalogue above {url}")


def search_body(collection: str, spatial: BBox | None, temporal, properties: dict | None) -> dict:
    """What the remote search is asked, so that it filters before anything is read."""
    from gridloom.functions.crs import reproject_bbox, same_crs

    body: dict = {"collections": [collection]}
    if spatial is not None:
        box = spatial if same_crs(spatial.crs, 4326) else reproject_bbox(spatial, 4326)
        body["bbox"] = [box.west, box.south, box.east, box.north]
    if temporal is not None:
        body["datetime"] = "/".join(str(x) if x is not None else ".." for x in temporal)
    if properties:
        body["query"] = properties
    return body


def check_assets(items: list[dict], bands: list[str] | None) -> list[str]:
    """The assets that all items have; the wanted bands must be among them or among the items' variables."""
    names = [sorted(i["assets"]) for i in items]
    if any(n != names[0] for n in names):
        raise CubeError("items have different assets")
    variables = items[0].get("properties", {}).get("cube:variables", {})
    known = [*names[0], *variables]
    if missing := [b for b in bands or [] if b not in known]:
        raise LabelNotAvailable(missing)
    return names[0]


def cube_schema(item: dict) -> CubeSchema:
    """Dimensions, reference system and bands from an item's cube metadata."""
    properties = item.get("properties", {})
    dims, crs = [], None
    for name, d in properties.get("cube:dimensions", {}).items():
        kind = d.get("type", "other")
        dims.append(Dim(name, d.get("axis", "x") if kind == "spatial" else kind))
        crs = d.get("reference_system", crs) if kind == "spatial" else crs
    dims.sort(key=lambda d: ("x", "y", "temporal").index(d.type) if d.type in ("x", "y", "temporal") else 9)
    bands = tuple(properties.get("cube:variables", {}))
    nodata = {v: m.get("nodata") for v, m in properties.get("cube:variables", {}).items()}
    return CubeSchema((*dims, Dim("bands", "bands", bands)), crs, {"nodata": {k: v for k, v in nodata.items() if v is not None}})


def load_stac(spark: SparkSession, url: str, spatial_extent: BBox | None = None, temporal_extent=None, bands: list[str] | None = None, properties: dict | None = None, resolution=None, projection=None, resampling: str = "near", reader: Callable[[str, dict], Iterator[pd.DataFrame]] | None = None, fetch: Callable[[str], dict] = fetch_json, search: Callable[[str, dict], list[dict]] | None = None) -> Cube:
    """A cube over the items of a collection, or one item, clipped to the extents.

    Assets named .zarr are read by chunks (sources/zarr.py), others as Parquet tables, or by a reader of one's own.
    reader(address, options): frames with the dimension columns, bands and value of one asset; called on executors.
    Scale and offset of the metadata are kept as attributes and not applied.
    """
    document = fetch(url)
    kind = kind_of(document)
    if kind == "COLLECTION":
        if spatial_extent is None and temporal_extent is None and not properties:
            raise NotImplementedError("a collection without any filter isn't supported")
        catalogue = parent_catalog(url, fetch)
        body = search_body(document["id"], spatial_extent, temporal_extent, properties)
        items = (search or _post)(f"{catalogue}/search", body)
    elif kind == "ITEM":
        items = [document]
    else:
        raise CubeError(f"can't load from a {kind}")
    if not items:
        raise NoDataAvailable(url)
    assets = check_assets(items, bands)
    schema = cube_schema(items[0])
    names = schema.names
    wanted = [a for a in assets if not bands or a in bands or a not in schema.band.labels] or assets
    rows = [(i["id"], a, i["assets"][a]["href"], json.dumps(i["assets"][a])) for i in items for a in wanted]
    found = spark.createDataFrame(rows, "item string, asset string, href string, about string")
    if reader is None and all(r[2].rstrip("/").endswith(".zarr") for r in rows):
        axes = {d.name: d.type for d in schema.dims}
        parts = [read_zarr(spark, r[2], [b for b in bands if b in schema.band.labels] if bands else list(schema.band.labels) or None, None, temporal_extent, schema.crs, axes) for r in rows]
        cells = parts[0].df.select(*names, VALUE)
        for part in parts[1:]:
            cells = cells.union(part.df.select(*names, VALUE))
    elif reader is None:
        cells = spark.read.parquet(*[r[2] for r in rows]).select(*names, F.col(VALUE).cast("double"))
    else:
        kinds = {d.name: "timestamp_ntz" if d.type == "temporal" else "string" if d.type == "bands" else "double" for d in schema.dims}

        def scan(batches):
            for batch in batches:
                for _, row in batch.iterrows():
                    for frame in reader(row["href"], json.loads(row["about"])):
                        yield frame[[*names, VALUE]]

        cells = found.repartition(max(1, len(rows))).mapInPandas(scan, ", ".join(f"`{n}` {k}" for n, k in kinds.items()) + f", {VALUE} double")
    for band, missing in schema.attrs["nodata"].items():
        cells = cells.withColumn(VALUE, F.when(~((F.col("bands") == band) & (F.col(VALUE) == F.lit(missing))), F.col(VALUE)))
    cube = Cube.of(cells, names, VALUE, list(schema.band.labels), schema.crs, schema.attrs)
    cube = clipped(Cube(cube.df, schema), spatial_extent, temporal_extent, bands)
    if resolution or projection:
        cube = cube.resample_spatial(projection, resolution or 0, resampling)
    return cube


def _post(url: str, body: dict) -> list[dict]:
    items = []
    while url:
        request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request) as answer:
            page = json.load(answer)
        items += page["features"]
        following = [x for x in page.get("links", []) if x["rel"] == "next"]
        url = following[0]["href"] if following else ""
        body = following[0].get("body", body) if following else body
    return items
