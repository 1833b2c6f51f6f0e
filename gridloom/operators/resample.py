"""Resampling of grids and of time."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import functions as F

from gridloom.errors import DimensionMissing
from gridloom.functions.crs import same_crs
from gridloom.functions.projection import transform
from gridloom.schema import VALUE

METHODS = ("resample_spatial", "resample_cube_spatial", "resample_cube_temporal")

# Methods that gather the source cells of a target cell, and those that weigh neighbours of its centre.
GATHER = {
    "average": lambda v: F.avg(v), "mode": lambda v: F.mode(v, True), "max": F.max, "min": F.min, "med": lambda v: F.median(v), "q1": lambda v: F.percentile(v, 0.25),
    "q3": lambda v: F.percentile(v, 0.75), "sum": F.sum, "rms": lambda v: F.sqrt(F.avg(v * v)),
}
REACH = {"near": 1, "bilinear": 1, "cubic": 2, "cubicspline": 2, "lanczos": 3}


def _weight(method: str, d):
    """The weight of a source cell at distance d (in cells) from the wanted place."""
    a = F.abs(d)
    if method == "bilinear":
        return F.greatest(F.lit(0.0), 1 - a)
    if method == "cubic":  # Catmull-Rom
        return F.when(a <= 1, (1.5 * a - 2.5) * a * a + 1).when(a < 2, ((-0.5 * a + 2.5) * a - 4) * a + 2).otherwise(0.0)
    if method == "cubicspline":
        return F.when(a <= 1, (0.5 * a - 1) * a * a + 2 / 3).when(a < 2, (2 - a) * (2 - a) * (2 - a) / 6).otherwise(0.0)
    x = d * math.pi
    return F.when(a < 1e-12, 1.0).when(a < 3, 3 * F.sin(x) * F.sin(x / 3) / (x * x)).otherwise(0.0)


def _axes(cube) -> tuple[tuple[float, float, int], tuple[float, float, int]]:
    """First label, step and number of labels of both (regular) spatial axes, in one job."""
    dx, dy = (d.name for d in cube.schema.spatial)
    row = cube.df.agg(*[f(d) for d in (dx, dy) for f in (F.min, F.max, F.count_distinct)]).first()

    def axis(low, high, n):
        return float(low), (float(high) - float(low)) / (n - 1) if n > 1 else 1.0, n

    return axis(*row[:3]), axis(*row[3:])


def _resample(cube, axes, target, crs, grid, method):
    """axes: of the cube; target: a table of the target cells (x, y); grid: steps of it, for methods that gather."""
    dx, dy = (d.name for d in cube.schema.spatial)
    rest = cube.others(dx, dy)
    source_crs = cube.schema.crs if cube.schema.crs is not None else crs
    (x0, sx, nx), (y0, sy, ny) = axes
    schema = replace(cube.schema, crs=crs)
    for d in (dx, dy):
        schema = schema.put(replace(schema.dim(d), labels=None))
    if method in GATHER:
        (tx, wx), (ty, wy) = grid
        px, py = transform(F.col(dx).cast("double"), F.col(dy).cast("double"), source_crs, crs)
        cells = cube.df.select(*rest, F.round((px - tx) / wx).cast("long").alias("_i"), F.round((py - ty) / wy).cast("long").alias("_j"), F.col(VALUE).cast("double").alias("_v"))
        got = cells.groupBy(*rest, "_i", "_j").agg(GATHER[method](F.col("_v")).alias(VALUE))
        keyed = target.withColumn("_i", F.round((F.col(dx) - tx) / wx).cast("long")).withColumn("_j", F.round((F.col(dy) - ty) / wy).cast("long"))
        every = keyed.crossJoin(cube.df.select(*rest).distinct()) if rest else keyed
        out = every.join(got, ["_i", "_j", *rest], "left")
        return type(cube)(out.select(*cube.dims, VALUE), schema)
    if method not in REACH:
        raise ValueError(f"unknown method: {method}")
    # where each target cell lies in the source, in cells
    px, py = transform(F.col(dx).cast("double"), F.col(dy).cast("double"), crs, source_crs)
    where = target.select(F.col(dx).alias("_tx"), F.col(dy).alias("_ty"), ((px - x0) / sx).alias("_px"), ((py - y0) / sy).alias("_py"))
    if method == "near":
        taps = where.select("_tx", "_ty", F.floor(F.col("_px") + 0.5).cast("long").alias("_i"), F.floor(F.col("_py") + 0.5).cast("long").alias("_j"), F.lit(1.0).alias("_w"))
    else:
        r = REACH[method]
        near = F.array(*[F.lit(k) for k in range(-r + 1, r + 1)])
        taps = where.withColumn("_a", F.explode(near)).withColumn("_b", F.explode(near))
        taps = taps.withColumn("_i", (F.floor("_px") + F.col("_a")).cast("long")).withColumn("_j", (F.floor("_py") + F.col("_b")).cast("long"))
        taps = taps.select("_tx", "_ty", "_i", "_j", (_weight(method, F.col("_px") - F.col("_i")) * _weight(method, F.col("_py") - F.col("_j"))).alias("_w")).filter("_w != 0")
    inside = F.col("_i").between(0, nx - 1) & F.col("_j").between(0, ny - 1)
    cells = cube.df.select(*rest, F.round((F.col(dx) - x0) / sx).cast("long").alias("_i"), F.round((F.col(dy) - y0) / sy).cast("long").alias("_j"), F.col(VALUE).cast("double").alias("_v"))
    hit = cells.join(taps.filter(inside), ["_i", "_j"])
    # weights of missing cells go to the others
    w = F.when(F.col("_v").isNotNull(), F.col("_w"))
    total = F.sum(w)
    got = hit.groupBy(*rest, F.col("_tx").alias(dx), F.col("_ty").alias(dy)).agg(F.when(F.abs(total) > 1e-9, F.sum(F.col("_v") * w) / F.nullif(total, F.lit(0.0))).alias(VALUE))
    every = target.crossJoin(cube.df.select(*rest).distinct()) if rest else target
    return type(cube)(every.join(got, [dx, dy, *rest], "left").select(*cube.dims, VALUE), schema)


def resample_spatial(cube, projection=None, resolution=0, method: str = "near", align: str = "upper-left"):
    """A new regular grid in another system or resolution (0: as it is). The grid is aligned to the named corner."""
    spatial = cube.schema.spatial
    if len(spatial) < 2:
        raise DimensionMissing("two spatial dimensions are needed")
    dx, dy = (d.name for d in spatial)
    crs = projection if projection is not None else cube.schema.crs
    axes = _axes(cube)
    (x0, sx, nx), (y0, sy, ny) = axes
    own = crs is None or cube.schema.crs is None or same_crs(crs, cube.schema.crs)
    edges = [(x, y) for x in (x0 - sx / 2, x0 + sx * (nx - 0.5)) for y in (y0 - sy / 2, y0 + sy * (ny - 0.5))]
    if not own:
        from gridloom.functions.crs import transform as moved

        many = 16  # along each edge, as edges may bend
        line = [(x0 + sx * (nx * k / many - 0.5), y) for k in range(many + 1) for y in (edges[0][1], edges[3][1])] + [(x, y0 + sy * (ny * k / many - 0.5)) for k in range(many + 1) for x in (edges[0][0], edges[3][0])]
        edges = [moved(x, y, cube.schema.crs, crs) for x, y in line]
    west, east = min(x for x, _ in edges), max(x for x, _ in edges)
    south, north = min(y for _, y in edges), max(y for _, y in edges)
    given = resolution if isinstance(resolution, (list, tuple)) else (resolution, resolution)
    rx = given[0] or (abs(sx) if own else (east - west) / nx)
    ry = given[1] or (abs(sy) if own else (north - south) / ny)
    cols, rows = max(1, round((east - west) / rx)), max(1, round((north - south) / ry))
    first_x = east - rx * (cols - 0.5) if "right" in align else west + rx / 2
    first_y = south + ry / 2 if "lower" in align else north - ry * (rows - 0.5)
    xs = cube.spark.range(cols).select((F.col("id") * rx + first_x).alias(dx))
    ys = cube.spark.range(rows).select((F.col("id") * ry + first_y).alias(dy))
    return _resample(cube, axes, xs.crossJoin(ys), crs, ((first_x, rx), (first_y, ry)), method)


def resample_cube_spatial(cube, target, method: str = "near"):
    """The grid of another cube."""
    dx, dy = (d.name for d in cube.schema.spatial)
    tx, ty = (d.name for d in target.schema.spatial)
    cells = target.label_table(tx).withColumnRenamed(tx, dx).crossJoin(target.label_table(ty).withColumnRenamed(ty, dy))
    ax, ay = _axes(target)
    crs = target.schema.crs if target.schema.crs is not None else cube.schema.crs
    return _resample(cube, _axes(cube), cells, crs, ((ax[0], ax[1]), (ay[0], ay[1])), method)


def resample_cube_temporal(cube, target, dimension: str | None = None, valid_within: float | None = None):
    """The time labels of another cube, each with the cells of the nearest label here (the earlier one of a tie).

    An as-of join over the label tables: labels of both cubes are sorted together and look back and ahead by a window, so no pairs are made.
    """
    from pyspark.sql import Window

    dim = cube.schema.only("temporal", dimension)
    other = target.schema.only("temporal", dimension if dimension in target.dims else None)
    kind = cube.df.schema[dim.name].dataType.simpleString()
    have = cube.label_table(dim.name).select(F.col(dim.name).alias("_at"), F.lit(True).alias("_own"))
    want = target.label_table(other.name).select(F.col(other.name).cast(kind).alias("_at"), F.lit(False).alias("_own"))
    block = F.date_trunc("month", "_at")  # blocks keep windows small; edges of a block look up the next block's outermost labels
    labels = have.union(want).withColumn("_block", block)
    edges = labels.filter("_own").groupBy("_block").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    order = Window.orderBy("_block")
    around = edges.unionByName(labels.filter("NOT _own").select("_block").distinct().join(edges, "_block", "left_anti"), allowMissingColumns=True)
    around = around.select("_block", F.last("_last", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.first("_first", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    w = Window.partitionBy("_block").orderBy("_at", F.col("_own").desc())
    own = F.when(F.col("_own"), F.col("_at"))
    near = labels.join(F.broadcast(around), "_block").select(
        "_at", "_own",
        F.coalesce(F.last(own, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("_before")).alias("_low"),
        F.coalesce(F.first(own, True).over(w.rowsBetween(0, Window.unboundedFollowing)), F.col("_after")).alias("_high"),
    ).filter("NOT _own")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    down, up = micros("_at") - micros("_low"), micros("_high") - micros("_at")
    pick = F.when(F.col("_high").isNull() | (down <= up), F.col("_low")).otherwise(F.col("_high"))
    gap = F.when(F.col("_high").isNull() | (down <= up), down).otherwise(up)
    pairs = near.select(F.col("_at").alias("_to"), pick.alias(dim.name), gap.alias("_gap"))
    joined = cube.df.join(pairs, dim.name)
    value = F.col(VALUE) if valid_within is None else F.when(F.col("_gap") <= int(valid_within * 86400e6), F.col(VALUE))
    names = [F.col("_to").alias(d) if d == dim.name else F.col(d) for d in cube.dims]
    return type(cube)(joined.select(*names, value.alias(VALUE)), cube.schema.put(replace(dim, labels=None)))
