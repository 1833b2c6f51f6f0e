"""Functions on array columns. Labelled arrays are arrays of struct(label, value), so their order counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.errors import (
    ArrayElementParameterConflict,
    ArrayElementParameterMissing,
    ArrayLengthMismatch,
    ArrayNotLabeled,
    QuantilesParameterConflict,
    QuantilesParameterMissing,
)

NOT_FOUND = 999999


def values(a: Column) -> Column:
    return F.transform(a, lambda s: s["value"])


def labels(a: Column) -> Column:
    return F.transform(a, lambda s: s["label"])


def array_create(data=None, repeat=1) -> Column:
    parts = data if isinstance(data, Column) else F.array(*[x if isinstance(x, Column) else F.lit(x) for x in (data if isinstance(data, (list, tuple)) else [] if data is None else [data])])
    return parts if repeat == 1 else F.flatten(F.array_repeat(parts, repeat))


def array_create_labeled(data: Column, names) -> Column:
    name = names if isinstance(names, Column) else F.array(*[F.lit(n) for n in names])
    zipped = F.zip_with(name, data, lambda n, v: F.struct(n.alias("label"), v.alias("value")))
    return F.when(F.size(name) == F.size(data), zipped).otherwise(F.raise_error(F.lit(ArrayLengthMismatch.__doc__)))


def array_element(a: Column, index=None, label=None, return_nodata=False, labeled=False) -> Column:
    if index is None and label is None:
        raise ArrayElementParameterMissing
    if index is not None and label is not None:
        raise ArrayElementParameterConflict
    if label is not None:
        if not labeled:
            raise ArrayNotLabeled
        hit = F.filter(a, lambda s: s["label"] == F.lit(label))
        out, there = F.get(hit, F.lit(0))["value"], F.size(hit) > 0
    else:
        i = F.lit(index) if index >= 0 else F.size(a) + F.lit(index)
        out, there = F.get(values(a) if labeled else a, i), (i >= 0) & (i < F.size(a))
    return out if return_nodata else F.when(there, out).otherwise(F.raise_error(F.lit("ArrayElementNotAvailable")))


def array_modify(a: Column, new: Column, index: int, length: int = 1, labeled=False) -> Column:
    """Removes `length` elements at index and puts `new` there. Of labelled arrays, no new label may be one that stays."""
    before, after = F.slice(a, 1, index), F.slice(a, index + length + 1, F.greatest(F.size(a), F.lit(1)))
    spliced = F.concat(before, new, after)
    if labeled:
        spliced = F.when(F.size(F.array_intersect(labels(F.concat(before, after)), labels(new))) == 0, spliced).otherwise(F.raise_error(F.lit("ArrayLabelConflict")))
    return F.when(F.size(a) >= index, spliced).otherwise(F.raise_error(F.lit("ArrayElementNotAvailable")))


def array_concat(a: Column, b: Column, labeled=False) -> Column:
    out = F.concat(a, b)
    if not labeled:
        return out
    return F.when(F.size(F.array_intersect(labels(a), labels(b))) == 0, out).otherwise(F.raise_error(F.lit("ArrayLabelConflict")))


def array_append(a: Column, value, label=None) -> Column:
    if label is None:
        return F.array_append(a, value)
    out = F.concat(a, F.array(F.struct(F.lit(label).alias("label"), (value if isinstance(value, Column) else F.lit(value)).alias("value"))))
    return F.when(~F.array_contains(labels(a), label), out).otherwise(F.raise_error(F.lit("LabelExists")))


def array_contains(a: Column, value) -> Column:
    if value is None or isinstance(value, (dict, list)):
        return F.lit(False)
    return F.coalesce(F.array_contains(a, value), F.lit(False))


def array_find(a: Column, value, reverse=False) -> Column:
    """Index from 0; NOT_FOUND if there is none."""
    if value is None or isinstance(value, float) and value != value:
        return F.lit(NOT_FOUND).cast("long")
    v = value if isinstance(value, Column) else F.lit(value)
    at = F.array_position(F.reverse(a) if reverse else a, v)
    found = F.size(a) - at if reverse else at - 1
    return F.when(F.coalesce(at, F.lit(0)) > 0, found.cast("long")).otherwise(F.lit(NOT_FOUND).cast("long"))


def array_find_label(a: Column, label, labeled=True) -> Column:
    if not labeled:
        return F.lit(None).cast("long")
    at = F.array_position(labels(a), label)
    return F.when(at > 0, at - 1)


def array_filter(a: Column, condition) -> Column:
    return F.filter(a, condition)


def array_labels(a: Column, labeled=False) -> Column:
    return labels(a) if labeled else F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1)).otherwise(F.array().cast("array<int>"))


def array_apply(a: Column, process) -> Column:
    return F.transform(a, process)


def array_interpolate_linear(a: Column, at: Column | None = None) -> Column:
    """Fills NULL and infinite gaps along the coordinates `at` (or the index); nothing beyond the outermost values."""
    where = F.transform(a, lambda v, i: i.cast("double")) if at is None else F.transform(at, lambda x: x.cast("double"))
    points = F.arrays_zip(where.alias("x"), a.alias("y"))
    known = F.filter(points, lambda p: p["y"].isNotNull() & (F.abs(p["y"].cast("double")) < float("inf")))

    def value(p: Column) -> Column:
        left = F.element_at(F.filter(known, lambda q: q["x"] <= p["x"]), -1)
        right = F.get(F.filter(known, lambda q: q["x"] >= p["x"]), F.lit(0))
        left = F.when(F.exists(known, lambda q: q["x"] <= p["x"]), left)
        between = left["y"] + (right["y"] - left["y"]) * (p["x"] - left["x"]) / (right["x"] - left["x"])
        usable = p["y"].isNotNull() & (F.abs(p["y"].cast("double")) < float("inf"))
        return F.when(usable | left.isNull() | right.isNull(), p["y"].cast("double")).otherwise(between)

    return F.transform(points, value)


def sort(a: Column, asc=True, nodata=None) -> Column:
    """nodata None drops NULL, False puts it first, True last."""
    present = F.array_compact(a)
    ordered = F.sort_array(present, asc=asc)
    if nodata is None:
        return ordered
    missing = F.filter(a, lambda v: v.isNull())
    return F.concat(ordered, missing) if nodata else F.concat(missing, ordered)


def order(a: Column, asc=True, nodata=None) -> Column:
    """Indices that sort the array. Descending is the reverse of the ascending order, ties included."""
    pairs = F.transform(a, lambda v, i: F.struct(v.isNull().alias("n"), v.alias("v"), i.alias("i")))
    if nodata is None:
        pairs = F.filter(pairs, lambda p: ~p["n"])
    if nodata is False and asc:
        pairs = F.transform(pairs, lambda p: F.struct((~p["n"]).alias("n"), p["v"].alias("v"), p["i"].alias("i")))
    out = F.transform(F.sort_array(pairs), lambda p: p["i"])
    return out if asc else F.reverse(out)


def rearrange(a: Column, order) -> Column:
    """Elements at the indices, which may be a part of them."""
    where = order if isinstance(order, Column) else F.array(*[F.lit(i) for i in order])
    return F.transform(where, lambda i: F.get(a, i))


def quantile_points(probabilities=None, q=None) -> list[float]:
    """The probabilities asked for: a list as it is; one whole number n stands for n equal parts."""
    if probabilities is not None and q is not None:
        raise QuantilesParameterConflict
    given = q if probabilities is None else probabilities
    if given is None:
        raise QuantilesParameterMissing
    if isinstance(given, (list, tuple)) and len(given) == 1 and float(given[0]).is_integer() and given[0] > 1:
        given = given[0]
    if isinstance(given, (int, float)) and not isinstance(given, bool):
        return [i / given for i in range(1, int(given))]
    return [float(p) for p in given]


def _known(a: Column) -> Column:
    return F.array_compact(a)


def _guarded(a: Column, out: Column, ignore_nodata: bool) -> Column:
    return out if ignore_nodata else F.when(F.size(_known(a)) == F.size(a), out)


def array_min(a, ignore_nodata=True):
    return _guarded(a, F.array_min(_known(a)), ignore_nodata)


def array_max(a, ignore_nodata=True):
    return _guarded(a, F.array_max(_known(a)), ignore_nodata)


def array_sum(a, ignore_nodata=True):
    total = F.aggregate(_known(a), F.lit(0.0), lambda s, v: s + v.cast("double"))
    return F.when(F.size(a) > 0, _guarded(a, total, ignore_nodata))


def array_product(a, ignore_nodata=True):
    total = F.aggregate(_known(a), F.lit(1.0), lambda s, v: s * v.cast("double"))
    return F.when(F.size(a) > 0, _guarded(a, total, ignore_nodata))


def array_mean(a, ignore_nodata=True):
    n = F.size(_known(a))
    return F.when(n > 0, _guarded(a, F.aggregate(_known(a), F.lit(0.0), lambda s, v: s + v.cast("double")) / n, ignore_nodata))


def array_variance(a, ignore_nodata=True):
    n = F.size(_known(a))
    mean = F.aggregate(_known(a), F.lit(0.0), lambda s, v: s + v.cast("double")) / F.nullif(n, F.lit(0))
    squares = F.aggregate(F.transform(_known(a), lambda v: v.cast("double") - mean), F.lit(0.0), lambda s, v: s + v * v)
    return F.when(n > 1, _guarded(a, squares / (n - 1), ignore_nodata))


def array_sd(a, ignore_nodata=True):
    return F.sqrt(array_variance(a, ignore_nodata))


def array_quantiles(a, points: list[float], ignore_nodata=True):
    s = F.sort_array(_known(a))
    n = F.size(s)

    def one(p: float) -> Column:
        at = F.lit(p) * (n - 1)
        low, high = F.get(s, F.floor(at).cast("int")), F.get(s, F.ceil(at).cast("int"))
        return F.when(n > 0, _guarded(a, low + (high - low) * (at - F.floor(at)), ignore_nodata))

    return F.array(*[one(p) for p in points])


def array_median(a, ignore_nodata=True):
    return F.get(array_quantiles(a, [0.5], ignore_nodata), F.lit(0))


def array_extrema(a, ignore_nodata=True):
    return F.array(array_min(a, ignore_nodata), array_max(a, ignore_nodata))


def array_count(a, condition=None):
    if condition is True:
        return F.size(a).cast("long")
    test = condition or (lambda v: v.isNotNull() & ~F.coalesce(F.abs(v.try_cast("double")) == float("inf"), F.lit(False)))
    return F.size(F.filter(a, test)).cast("long")


def array_first(a, ignore_nodata=True):
    return F.get(_known(a) if ignore_nodata else a, F.lit(0))


def array_last(a, ignore_nodata=True):
    return F.get(F.reverse(_known(a) if ignore_nodata else a), F.lit(0))


def array_any(a, ignore_nodata=True):
    b = F.transform(a, lambda v: v.cast("boolean"))
    return F.when(F.size(a) > 0, F.exists(F.transform(b, lambda v: F.coalesce(v, F.lit(False))), lambda v: v) if ignore_nodata else F.exists(b, lambda v: v))


def array_all(a, ignore_nodata=True):
    b = F.transform(a, lambda v: v.cast("boolean"))
    return F.when(F.size(a) > 0, F.forall(F.transform(b, lambda v: F.coalesce(v, F.lit(True))), lambda v: v) if ignore_nodata else F.forall(b, lambda v: v))


def _running(a, start, step, ignore_nodata):
    state = F.struct(start.alias("s"), F.lit(False).alias("bad"), F.array().cast("array<double>").alias("out"))

    def add(st, v):
        v = v.cast("double")
        s = F.when(v.isNull(), st["s"]).otherwise(step(st["s"], v))
        bad = st["bad"] | v.isNull() if not ignore_nodata else st["bad"]
        return F.struct(s.alias("s"), bad.alias("bad"), F.array_append(st["out"], F.when(v.isNotNull() & ~bad, s)).alias("out"))

    return F.aggregate(a, state, add, lambda st: st["out"])


def array_cumsum(a, ignore_nodata=True):
    return _running(a, F.lit(0.0), lambda s, v: s + v, ignore_nodata)


def array_cumproduct(a, ignore_nodata=True):
    return _running(a, F.lit(1.0), lambda s, v: s * v, ignore_nodata)


def array_cummin(a, ignore_nodata=True):
    return _running(a, F.lit(None).cast("double"), lambda s, v: F.least(s, v), ignore_nodata)


def array_cummax(a, ignore_nodata=True):
    return _running(a, F.lit(None).cast("double"), lambda s, v: F.greatest(s, v), ignore_nodata)
