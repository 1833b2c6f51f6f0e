"""Cell-wise, along a dimension, in windows over space, and in polygons."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from gridloom.errors import DimensionMismatch, GeometriesOverlap, KernelDimensionsUneven
from gridloom.functions.geometry import Shapes, overlap
from gridloom.functions.reducers import Group, Series
from gridloom.operators.masks import mask_polygon
from gridloom.schema import VALUE, Dim

METHODS = ("apply", "apply_dimension", "apply_polygon", "apply_kernel", "apply_neighborhood", "array_filter_labels")


def apply(cube, process, context=None):
    """process(x) in every cell."""
    x = F.col(VALUE)
    return cube.with_value(process(x, context) if context is not None else process(x))


def apply_dimension(cube, process, dimension: str, target_dimension: str | None = None, context=None):
    """A function along a dimension.

    Functions marked `along` (running sums, interpolation) become windows and keep labels. Others get the cells in
    order as an array column and give one; if its length differs, labels become 0, 1, ...
    """
    dim = cube.schema.dim(dimension)
    rest = cube.others(dimension)
    if target_dimension and target_dimension != dimension and target_dimension in cube.dims and cube.label_count(target_dimension) > 1:
        raise DimensionMismatch(f"{target_dimension} has more than one label")
    if getattr(process, "along", False):
        kind = cube.df.schema[dimension].dataType.typeName()
        place = F.col(dimension)
        order = F.unix_micros(place.cast("timestamp")) if kind.startswith("timestamp") else cube.order_of(dimension).cast("double")
        value = process(Series(F.col(VALUE), order.cast("double"), tuple(rest)))
        out = type(cube)(cube.df.select(*cube.dims, value.alias(VALUE)), cube.schema)
    else:
        cells = F.sort_array(F.collect_list(F.struct(cube.order_of(dimension).alias("o"), F.col(dimension).alias("l"), F.col(VALUE).alias("v"))))
        rows = cube.df.groupBy(*rest).agg(cells.alias("_c"))
        new = process(F.transform("_c", lambda s: s["v"]), context) if context is not None else process(F.transform("_c", lambda s: s["v"]))
        rows = rows.select(*rest, "_c", new.alias("_n"))
        each = rows.select(*rest, "_c", F.posexplode("_n").alias("_i", VALUE), F.size("_n").alias("_m"))
        resized = bool(each.filter(F.size("_c") != F.col("_m")).limit(1).count())
        label = F.col("_i") if resized else F.get("_c", F.col("_i"))["l"]
        kept = dim if not resized else Dim(dimension, dim.type, None)
        out = type(cube)(each.select(*rest, label.alias(dimension), VALUE).select(*cube.dims, VALUE), cube.schema.put(kept))
    if not target_dimension or target_dimension == dimension:
        return out
    if target_dimension in cube.dims:
        out = type(cube)(out.df.drop(target_dimension), out.schema.without(target_dimension))
    schema = replace(out.schema, dims=tuple(replace(d, name=target_dimension) if d.name == dimension else d for d in out.schema.dims))
    return type(cube)(out.df.withColumnRenamed(dimension, target_dimension), schema)


def array_filter_labels(cube, condition, dimension: str):
    """Keeps the labels along a dimension for which the condition holds in all cells."""
    good = cube.df.groupBy(dimension).agg(F.bool_and(F.coalesce(condition(F.col(VALUE)), F.lit(False))).alias("_ok")).filter("_ok").select(dimension)
    dim = cube.schema.dim(dimension)
    return type(cube)(cube.df.join(good, dimension, "left_semi").select(*cube.dims, VALUE), cube.schema.put(replace(dim, labels=None)))


def apply_polygon(cube, polygons, process, mask_value=None, context=None):
    """The process inside the polygons, which must not overlap; outside, cells become mask_value."""
    shapes = Shapes.of(polygons, cube.schema.crs)
    for i, a in enumerate(shapes.parts):
        if any(overlap(a, b) for b in shapes.parts[:i]):
            raise GeometriesOverlap
    inside = mask_polygon(cube, shapes)
    return mask_polygon(apply(inside, process, context), shapes, mask_value)


def _indexed(cube, dim: str, name: str):
    """(label, its place from 0): as many rows as the axis has labels, numbered by one sort. Spark sees its size when it joins it."""
    labels = cube.label_table(dim)
    ordered = F.sort_array(F.collect_list(dim))
    return labels.agg(ordered.alias("_l")).select(F.posexplode("_l").alias(name, dim))


def apply_kernel(cube, kernel, factor: float = 1.0, border=0, replace_invalid: float = 0):
    """Convolution over x and y with a small kernel (rows along x, columns along y), which is flipped.

    border: a number, or replicate, reflect, reflect_pixel or wrap. Each cell is sent to the places it counts for, so one
    grouped sum gives the result; a kernel of k cells makes k rows a cell, added up before the shuffle.
    """
    rows, cols = len(kernel), len(kernel[0])
    if rows % 2 == 0 or cols % 2 == 0:
        raise KernelDimensionsUneven
    dx, dy = (d.name for d in cube.schema.spatial)
    rest = cube.others(dx, dy)
    xs, ys = _indexed(cube, dx, "_i"), _indexed(cube, dy, "_j")
    size = xs.agg(F.max("_i") + 1).first()[0] or 0, ys.agg(F.max("_j") + 1).first()[0] or 0
    value = F.coalesce(F.col(VALUE).cast("double"), F.lit(float(replace_invalid)))
    cells = cube.df.join(xs, dx).join(ys, dy).select(*rest, "_i", "_j", value.alias("_v"))
    taps = [(r - rows // 2, c - cols // 2, float(kernel[r][c])) for r in range(rows) for c in range(cols)]
    # target (i, j) reads the source (i - a, j - b) with weight w; where that is outside, the border rule names a source inside
    tap = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(w).alias("w")) for a, b, w in taps]))
    spread = cells.select(*rest, "_i", "_j", "_v", tap.alias("_t"))
    if isinstance(border, str):
        spread = _targets(spread, "_i", F.col("_t")["a"], size[0], border, rows // 2)
        spread = _targets(spread, "_j", F.col("_t")["b"], size[1], border, cols // 2)
    else:
        spread = spread.withColumn("_i", F.col("_i") + F.col("_t")["a"]).withColumn("_j", F.col("_j") + F.col("_t")["b"])
    spread = spread.filter(F.col("_i").between(0, size[0] - 1) & F.col("_j").between(0, size[1] - 1))
    total = F.sum(F.col("_v") * F.col("_t")["w"])
    if not isinstance(border, str) and border:
        total = total + (F.lit(sum(w for _, _, w in taps)) - F.sum(F.col("_t")["w"])) * F.lit(float(border))
    kind = cube.df.schema[VALUE].dataType
    out = spread.groupBy(*rest, "_i", "_j").agg((total * F.lit(float(factor))).cast(kind).alias(VALUE))
    return type(cube)(out.join(xs, "_i").join(ys, "_j").select(*cube.dims, VALUE), cube.schema)


def _targets(rows, name: str, shift, size: int, border: str, reach: int):
    """All places (perhaps several near the border) that read this source with this shift."""
    here = F.col(name)
    candidates = [here + shift]
    for k in range(1, reach + 1):
        # outside places -k and size - 1 + k, and the source that each border rule reads there
        low = {"replicate": 0, "reflect": k - 1, "reflect_pixel": k, "wrap": size - k}[border]
        high = {"replicate": size - 1, "reflect": size - k, "reflect_pixel": size - 1 - k, "wrap": k - 1}[border]
        candidates.append(F.when(here == low, F.lit(-k) + shift))
        candidates.append(F.when(here == high, F.lit(size - 1 + k) + shift))
    return rows.withColumn(name, F.explode(F.array_compact(F.array(*candidates))))


def apply_neighborhood(cube, process, size: dict, overlap: dict | None = None, context=None):
    """Moving windows over dimensions: each is `size` labels long, with `overlap` more on both sides; a reducer makes one cell of each.

    Windows stand every size + overlap labels (every label at least); the window at place i begins half a window before i.
    Beyond the edge there are no cells. Result labels are those at the windows' places.
    """
    df = cube.df
    for d, n in size.items():
        cube.schema.dim(d)
        extra = (overlap or {}).get(d, 0)
        window = n + 2 * extra
        if window <= 0:
            raise ValueError(f"an empty window along {d}")
        stride = max(n + extra, 1)
        index = _indexed(cube, d, f"_{d}")
        at = F.col(f"_{d}")
        # anchors i with i - window//2 <= at <= i - window//2 + window - 1
        first, last = at + window // 2 - window + 1, at + window // 2
        df = df.join(index, d).withColumn(f"_a_{d}", F.explode(F.sequence(first, last))).filter((F.col(f"_a_{d}") % stride == 0) & (F.col(f"_a_{d}") >= 0)).drop(d)
    rest = [d for d in cube.dims if d not in size]
    value = process(Group(F.col(VALUE), F.struct(*[F.col(f"_{d}") for d in size])))
    out = df.groupBy(*rest, *[f"_a_{d}" for d in size]).agg(value.alias(VALUE))
    for d in size:
        out = out.join(_indexed(cube, d, f"_a_{d}"), f"_a_{d}")
    schema = cube.schema
    for d in size:
        schema = schema.put(replace(schema.dim(d), labels=None))
    return type(cube)(out.select(*cube.dims, VALUE), schema)
