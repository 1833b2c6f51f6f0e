"""Reductions along dimensions, over time and over zones. All are grouped aggregations with partial sums."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.geometry import Shapes, covering, edge_table
from gridloom.functions.reducers import Group
from gridloom.schema import VALUE, Dim, Interval

#: Intervals up to which the lookup is one expression.
FEW = 16
METHODS = ("reduce_dimension", "reduce_spatial", "aggregate_temporal", "aggregate_temporal_period", "aggregate_spatial")


def _call(reducer, group: Group, context=None) -> Column:
    return reducer(group, context=context) if context is not None else reducer(group)


def reduce_dimension(cube, reducer, dimension: str, context=None):
    """The reducer over the cells along a dimension, which goes. The reducer may give an array (as quantiles do)."""
    cube.schema.dim(dimension)
    rest = cube.others(dimension)
    out = cube.df.groupBy(*rest).agg(_call(reducer, Group(F.col(VALUE), cube.order_of(dimension) if not _is_band(cube, dimension) else F.col(dimension)), context).alias(VALUE))
    return type(cube)(out, cube.schema.without(dimension))


def _is_band(cube, dimension: str) -> bool:
    return cube.schema.dim(dimension).type == "bands"


def reduce_spatial(cube, reducer, context=None):
    """Over x and y together; over all dimensions if there is neither."""
    spatial = [d.name for d in cube.schema.spatial] or cube.dims
    rest = cube.others(*spatial)
    order = F.struct(*[F.col(d) for d in spatial])
    out = cube.df.groupBy(*rest).agg(_call(reducer, Group(F.col(VALUE), order), context).alias(VALUE))
    return type(cube)(out, cube.schema.without(*spatial))


def _time(x) -> datetime:
    return x if isinstance(x, datetime) else datetime.fromisoformat(str(x).replace("Z", ""))


def aggregate_temporal(cube, intervals, reducer, labels=None, dimension=None, context=None, closed: str = "right"):
    """The reducer over the cells of each interval, (start, end] by default, [start, end) with closed="left".

    Every label appears for every combination of the other labels; empty intervals are NULL. The intervals are a list that is
    part of the query, so the lookup is an expression on the time column: no join, and cells outside fall away in the scan.
    """
    dim = cube.schema.only("temporal", dimension)
    spans = [(_time(i.start), _time(i.end)) if isinstance(i, Interval) else (_time(i[0]), _time(i[1])) for i in intervals]
    ordered = sorted(spans)
    if any(b[0] < a[1] for a, b in zip(ordered, ordered[1:])):
        raise NotImplementedError("intervals overlap")
    shown = [str(x) for x in labels] if labels is not None else [s.strftime("%Y-%m-%dT%H:%M:%S") for s, _ in spans]
    kind = cube.df.schema[dim.name].dataType.simpleString()
    t = F.date_trunc("second", F.col(dim.name)).cast(kind)
    if len(spans) > FEW:
        return _looked_up(cube, dim, t, list(zip(spans, shown)), shown, closed, reducer, context)
    label = F.lit(None).cast("string")
    for (start, end), name in zip(spans, shown):
        a, b = F.lit(start).cast(kind), F.lit(end).cast(kind)
        label = F.when((t > a) & (t <= b) if closed == "right" else (t >= a) & (t < b), F.lit(name)).otherwise(label)
    return _binned(cube, dim, label, shown, reducer, context)


def _looked_up(cube, dim: Dim, t: Column, rows: list, shown: list[str], closed: str, reducer, context):
    """Many intervals: a table with a row for each day that an interval touches, joined on the day."""
    kind = cube.df.schema[dim.name].dataType.simpleString()
    table = cube.spark.createDataFrame([(a, b, n) for (a, b), n in rows], "_a timestamp_ntz, _b timestamp_ntz, _bin string")
    days = table.select("_bin", F.col("_a").cast(kind).alias("_a"), F.col("_b").cast(kind).alias("_b"), F.explode(F.sequence(F.col("_a").cast("date"), F.col("_b").cast("date"))).alias("_day"))
    inside = (F.col("_t") > F.col("_a")) & (F.col("_t") <= F.col("_b")) if closed == "right" else (F.col("_t") >= F.col("_a")) & (F.col("_t") < F.col("_b"))
    cells = cube.df.withColumn("_t", t).withColumn("_day", F.col("_t").cast("date")).join(days, "_day").filter(inside)
    return _filled(cube, dim, cells, shown, reducer, context)


def _binned(cube, dim: Dim, label: Column, shown: list[str], reducer, context):
    return _filled(cube, dim, cube.df.withColumn("_bin", label).filter(F.col("_bin").isNotNull()), shown, reducer, context)


def _filled(cube, dim: Dim, cells, shown: list[str], reducer, context):
    rest = cube.others(dim.name)
    out = cells.groupBy(*rest, F.col("_bin").alias(dim.name)).agg(_call(reducer, Group(F.col(VALUE), F.col(dim.name)), context).alias(VALUE))
    keys = cube.df.select(*rest).distinct().withColumn(dim.name, F.explode(F.array(*[F.lit(x) for x in shown])))
    filled = keys.join(out, [*rest, dim.name], "left")
    return type(cube)(filled.select(*cube.dims, VALUE), cube.schema.put(replace(dim, labels=tuple(shown))))


def season_start(t: Column) -> Column:
    """December, March, June or September 1 on or before t."""
    return F.add_months(F.date_trunc("quarter", F.add_months(t.cast("date"), 1)).cast("date"), -1)


def period_label(t: Column, period: str) -> Column:
    """The label of the calendar period that t is in; weeks and months are named by their last day, the others by their start."""
    if period == "week":
        return F.timestamp_add("DAY", F.lit(6), F.date_trunc("week", t).cast("timestamp_ntz"))
    if period == "month":
        return F.last_day(t.cast("date")).cast("timestamp_ntz")
    if period == "season":
        return season_start(t).cast("timestamp_ntz")
    if period in ("hour", "day", "year"):
        return F.date_trunc(period, t).cast("timestamp_ntz")
    raise NotImplementedError(f"unknown period: {period}")


def _steps(period: str, low: Column, high: Column) -> Column:
    """All labels from low to high."""
    unit = {"hour": "interval 1 hour", "day": "interval 1 day", "week": "interval 7 days", "season": "interval 3 months", "year": "interval 1 year"}
    if period == "month":
        first = F.sequence(F.date_trunc("month", low).cast("timestamp_ntz"), F.date_trunc("month", high).cast("timestamp_ntz"), F.expr("interval 1 month"))
        return F.transform(first, lambda d: F.last_day(d.cast("date")).cast("timestamp_ntz"))
    return F.sequence(low, high, F.expr(unit[period]))


def aggregate_temporal_period(cube, reducer, period: str, dimension=None, context=None, closed: str = "right"):
    """The reducer over calendar periods: hour, day, week, month, season, year, dekad, decade, decade-ad, tropical-season.

    Gaps between the first and the last period are NULL for every combination of the other labels.
    """
    dim = cube.schema.only("temporal", dimension)
    if period in ("dekad", "decade", "decade-ad", "tropical-season"):
        low, high = cube.df.agg(F.min(dim.name), F.max(dim.name)).first()
        spans, labels = period_intervals(low, high, period)
        return aggregate_temporal(cube, spans, reducer, labels, dim.name, context, closed)
    label = period_label(F.col(dim.name), period)
    rest = cube.others(dim.name)
    out = cube.df.groupBy(*rest, label.alias("_label")).agg(_call(reducer, Group(F.col(VALUE), F.col(dim.name)), context).alias(VALUE))
    span = out.agg(F.min("_label").alias("a"), F.max("_label").alias("b"))
    every = span.select(F.explode(_steps(period, F.col("a"), F.col("b"))).alias("_label"))
    # the calendar is one row a period: its length is that of the time span, not of the data
    grid = out.select(*rest).distinct().crossJoin(F.broadcast(every)) if rest else every
    filled = grid.join(out, [*rest, "_label"], "left")
    names = [F.col("_label").alias(d) if d == dim.name else F.col(d) for d in cube.dims]
    return type(cube)(filled.select(*names, VALUE), cube.schema.put(replace(dim, labels=None)))


def period_intervals(low: datetime, high: datetime, period: str) -> tuple[list[tuple[datetime, datetime]], list[str]]:
    """Neighbouring intervals that cover low to high, with their labels."""
    starts: list[datetime] = []
    if period in ("decade", "decade-ad"):
        shift = 1 if period == "decade-ad" else 0
        y = (low.year - shift) // 10 * 10 + shift
        last = (high.year - shift) // 10 * 10 + shift
        while y <= last:
            starts.append(datetime(y, 1, 1))
            y += 10
        end = datetime(y, 1, 1)
        names = [str(s.year) for s in starts]
    elif period == "tropical-season":
        at = datetime(low.year, 5, 1) if 5 <= low.month < 11 else datetime(low.year - (low.month < 5), 11, 1)
        while at <= high:
            starts.append(at)
            at = datetime(at.year, 11, 1) if at.month == 5 else datetime(at.year + 1, 5, 1)
        end = at
        names = [f"{s.year}-{'mjjaso' if s.month == 5 else 'ndjfma'}" for s in starts]
    elif period == "dekad":
        at = datetime(low.year, low.month, min((low.day - 1) // 10, 2) * 10 + 1)
        while at <= high:
            starts.append(at)
            at = at.replace(day=at.day + 10) if at.day < 21 else (at.replace(day=1) + timedelta(days=32)).replace(day=1)
        end = at
        names = [f"{s.year}-{s.timetuple().tm_yday // 10:02d}" for s in starts]
    else:
        raise NotImplementedError(f"unknown period: {period}")
    return list(zip(starts, [*starts[1:], end])), names


def aggregate_spatial(cube, geometries, reducer, context=None, target: str = "geometry"):
    """The reducer over the cells whose centre lies in each geometry; geometries without cells are NULL.

    geometries: GeoJSON, a path or address of it, or a vector cube, whose ids then are the labels. Only distinct (x, y) labels are tested, by a
    join with the edges of their strip.
    """
    edges, ids = edge_table(cube.spark, geometries, cube.schema.crs)
    dx, dy = (d.name for d in cube.schema.spatial)
    rest = cube.others(dx, dy)
    labels = None if hasattr(geometries, "df") else tuple(range(len(Shapes.of(geometries).parts)))
    keys = ids.select(F.col("geometry").cast("long" if labels is None else "int").alias(target))
    zones = covering(cube.df, dx, dy, edges).select(F.col("geometry").cast(keys.schema[target].dataType).alias(target), dx, dy)
    hit = cube.df.join(zones, [dx, dy])
    out = hit.groupBy(target, *rest).agg(_call(reducer, Group(F.col(VALUE), F.struct(dx, dy)), context).alias(VALUE))
    if rest:
        keys = cube.df.select(*rest).distinct().crossJoin(keys)
    filled = keys.join(out, [target, *rest], "left")
    dims = (Dim(target, "other", labels), *cube.schema.without(dx, dy).dims)
    return type(cube)(filled.select(target, *rest, VALUE), replace(cube.schema, dims=dims))
