"""Reducers and running functions. One name serves three forms: a Group (aggregation over rows), a Series (window over rows)
and an array column (higher-order functions)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from gridloom.errors import ArrayElementParameterConflict, ArrayElementParameterMissing
from gridloom.functions import arrays as A

INF = float("inf")


@dataclass(frozen=True)
class Group:
    """The cells that one result is made of: their values, and what puts them in order."""

    value: Column
    order: Column | None = None


@dataclass(frozen=True)
class Series:
    """The cells along one dimension, for functions that give a value for each cell."""

    value: Column
    order: Column
    by: tuple[str, ...] = ()

    @property
    def window(self):
        return Window.partitionBy(*self.by).orderBy(self.order)


Reducer = Callable[..., Column]


def _guard(g: Group, out: Column, ignore_nodata: bool) -> Column:
    return out if ignore_nodata else F.when(F.count(g.value) == F.count(F.lit(1)), out)


def _form(on_group, on_array):
    def run(data, ignore_nodata: bool = True, **_):
        if isinstance(data, Group):
            return _guard(data, on_group(data), ignore_nodata)
        return on_array(data, ignore_nodata)

    return run


def _num(g: Group) -> Column:
    return g.value.cast("double")


_min = _form(lambda g: F.min(g.value), A.array_min)
_max = _form(lambda g: F.max(g.value), A.array_max)
_sum = _form(lambda g: F.when(F.count(F.lit(1)) > 0, F.coalesce(F.sum(_num(g)), F.lit(0.0))), A.array_sum)
product = _form(lambda g: F.when(F.count(F.lit(1)) > 0, F.coalesce(F.product(_num(g)), F.lit(1.0))), A.array_product)
mean = _form(lambda g: F.avg(_num(g)), A.array_mean)
median = _form(lambda g: F.median(_num(g)), A.array_median)
sd = _form(lambda g: F.stddev_samp(_num(g)), A.array_sd)
variance = _form(lambda g: F.var_samp(_num(g)), A.array_variance)
extrema = _form(lambda g: F.array(F.min(g.value), F.max(g.value)), A.array_extrema)


def quantiles(data, probabilities=None, q=None, ignore_nodata: bool = True, **_):
    """An array with one value for each probability, interpolated linearly."""
    points = A.quantile_points(probabilities, q)
    if not isinstance(data, Group):
        return A.array_quantiles(data, points, ignore_nodata)
    return _guard(data, F.percentile(_num(data), F.array(*[F.lit(p) for p in points])), ignore_nodata)


def count(data, condition=None, context=None, **_):
    """Valid cells; all cells with condition True; cells where condition(x) holds."""
    if not isinstance(data, Group):
        return A.array_count(data, condition)
    if condition is True:
        return F.count(F.lit(1))
    x = data.value
    test = condition(x, **(context or {})) if callable(condition) else x.isNotNull() & ~F.coalesce(F.abs(x.try_cast("double")) == INF, F.lit(False))
    return F.count_if(test)


def _edge(pick, on_array):
    def run(data, ignore_nodata: bool = True, **_):
        if not isinstance(data, Group):
            return on_array(data, ignore_nodata)
        if not ignore_nodata:  # a struct isn't NULL, so its value may be
            return pick(F.struct(data.value.alias("v")), data.order)["v"]
        return pick(data.value, F.when(data.value.isNotNull(), data.order))

    return run


first = _edge(F.min_by, A.array_first)
last = _edge(F.max_by, A.array_last)


def _any(data, ignore_nodata: bool = True, **_):
    if not isinstance(data, Group):
        return A.array_any(data, ignore_nodata)
    b = data.value.cast("boolean")
    some = F.bool_or(F.coalesce(b, F.lit(False)))
    return some if ignore_nodata else F.when(some, True).when(F.count(b) == F.count(F.lit(1)), some)


def _all(data, ignore_nodata: bool = True, **_):
    if not isinstance(data, Group):
        return A.array_all(data, ignore_nodata)
    b = data.value.cast("boolean")
    every = F.bool_and(F.coalesce(b, F.lit(True)))
    return every if ignore_nodata else F.when(~every, False).when(F.count(b) == F.count(F.lit(1)), every)


def array_element(data, index=None, label=None, return_nodata: bool = False, **_):
    """On a Group: the cell with that label, or at that place of the order (through the sorted values)."""
    if not isinstance(data, Group):
        return A.array_element(data, index, label, return_nodata)
    if index is None and label is None:
        raise ArrayElementParameterMissing
    if index is not None and label is not None:
        raise ArrayElementParameterConflict
    if label is not None:
        out = F.max(F.when(data.order == F.lit(label), data.value))
        there = F.count_if(data.order == F.lit(label)) > 0
        return out if return_nodata else F.when(there, out).otherwise(F.raise_error(F.lit("ArrayElementNotAvailable")))
    cells = F.sort_array(F.collect_list(F.struct(data.order.alias("o"), data.value.alias("v"))))
    return A.array_element(F.transform(cells, lambda s: s["v"]), index, None, return_nodata)


def array_contains(data, value, **_):
    if not isinstance(data, Group):
        return A.array_contains(data, value)
    return F.lit(False) if value is None else F.coalesce(F.bool_or(data.value == F.lit(value)), F.lit(False))


def _running(on_window, on_array):
    def run(data, ignore_nodata: bool = True, **_):
        if not isinstance(data, Series):
            return on_array(data, ignore_nodata)
        frame = data.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = F.when(data.value.isNotNull(), on_window(data.value.cast("double")).over(frame))
        return out if ignore_nodata else F.when(F.count_if(data.value.isNull()).over(frame) == 0, out)

    run.along = True
    return run


cumsum = _running(F.sum, A.array_cumsum)
cumproduct = _running(F.product, A.array_cumproduct)
cummin = _running(F.min, A.array_cummin)
cummax = _running(F.max, A.array_cummax)


def array_interpolate_linear(data, **_):
    """Fills gaps linearly along the labels: numbers, or timestamps by their seconds."""
    if not isinstance(data, Series):
        return A.array_interpolate_linear(data)
    y = F.when(F.abs(data.value.cast("double")) < INF, data.value.cast("double"))
    x = F.when(y.isNotNull(), data.order)
    before, after = data.window.rowsBetween(Window.unboundedPreceding, 0), data.window.rowsBetween(0, Window.unboundedFollowing)
    x0, y0 = F.last(x, ignorenulls=True).over(before), F.last(y, ignorenulls=True).over(before)
    x1, y1 = F.first(x, ignorenulls=True).over(after), F.first(y, ignorenulls=True).over(after)
    fill = y0 + (y1 - y0) * (data.order - x0) / F.nullif(x1 - x0, F.lit(0.0))
    return F.when(y.isNotNull() | y0.isNull() | y1.isNull(), data.value.cast("double")).otherwise(fill)


array_interpolate_linear.along = True
