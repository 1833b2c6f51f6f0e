import math

import pytest
from pyspark.sql import functions as F

from gridloom.errors import ArrayElementParameterConflict, ArrayElementParameterMissing, MinMaxSwapped, QuantilesParameterConflict, QuantilesParameterMissing
from gridloom.functions import arrays as A
from gridloom.functions import scalar as S

INF = float("inf")


def values(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first().asDict()


def test_math(spark):
    got = values(
        spark, a=S.divide(1, 0), b=S.divide(-1, 0), c=S.divide(0, 0), d=S.mod(5, -3), e=S.mod(-5, 3), f=S._round(2.5), g=S._round(-0.5), h=S._round(1234.5, -2), i=S._int(-2.7), j=S._int(2.7),
        k=S.ln(0), l=S.ln(-1), m=S.arccos(2), n=S.sqrt(-1), o=S.clip(5, 1, 3), p=S.clip(None, 1, 3), q=S.linear_scale_range(0.3, -1, 1, 0, 255), r=S.normalized_difference(5, 3), s=S.log(8, 2), t=S.linear_scale_range(25.5, 0, 255),
        u=S.add(INF, 1), v=S.subtract(INF, INF), w=S.floor(-1.5), x=S.ceil(1e300), y=S.artanh(2), z=S.sgn(-3),
    )
    assert (got["a"], got["b"], got["c"]) == (INF, -INF, None)
    assert (got["d"], got["e"]) == (-1, 1)
    assert (got["f"], got["g"], got["h"], got["i"], got["j"]) == (2, 0, 1200, -2, 2)
    assert got["k"] == -INF and got["l"] is None and got["m"] is None and got["n"] is None
    assert got["o"] == 3 and got["p"] is None and math.isclose(got["q"], 165.75) and math.isclose(got["r"], 0.25) and math.isclose(got["s"], 3) and math.isclose(got["t"], 0.1)
    assert got["u"] == INF and got["v"] is None and got["w"] == -2 and got["x"] == 1e300 and got["y"] is None and got["z"] == -1
    with pytest.raises(MinMaxSwapped):
        S.clip(1, 3, 2)


def test_comparison(spark):
    got = values(
        spark, a=S.eq(1, None), b=S.eq(1, 1), c=S.eq(1.02, 1, delta=0.01), d=S.eq(-1, -1.001, delta=0.01), e=S.eq("Test", "test"), f=S.eq("Test", "test", case_sensitive=False), g=S.eq(1, "1"), h=S.eq(True, 1), i=S.neq(1, None),
        j=S.between(1, 0, 1), k=S.between(1, 0, 1, exclude_max=True), l=S.between(1, None, 2), m=S.is_valid(INF), n=S.is_valid(F.lit(float("nan"))), o=S.is_infinite("x"), p=S.is_nan(F.lit(float("nan"))), q=S.is_nan(None), r=S.is_nodata(None),
        s=S.gt(1, None), t=S.gte(2, 2), u=S.is_valid("text"),
    )
    assert [got[c] for c in "abcdefghi"] == [None, True, False, True, False, True, False, False, None]
    assert [got[c] for c in "jklmnopqrstu"] == [True, False, None, False, False, False, True, True, True, None, True, True]


def test_logic(spark):
    null = F.lit(None).cast("boolean")
    got = values(spark, a=S._and(False, null), b=S._and(True, null), c=S._or(True, null), d=S._or(False, null), e=S.xor(True, null), f=S._not(null), g=S._if(null, "a", "b"), h=S._if(True, "a"), i=S._if(False, "a"))
    assert list(got.values()) == [False, None, True, None, None, None, "b", "a", None]


def test_text(spark):
    got = values(
        spark, a=S.text_begins("Lorem ipsum", "amet"), b=S.text_begins("Lorem", "lorem", False), c=S.text_contains("Lorem", "ore"), d=S.text_ends("Lorem amet", "AMET", False), e=S.text_begins(None, "a"), f=S.text_ends("", "a"),
        g=S.text_concat(["Hello", "World"], " "), h=S.text_concat([2, 0], 1), i=S.text_concat([1, 2, 3, 4, 5, 6, 7, 8, 9, 0]), j=S.text_concat([None, True, False, "a"], "\n"),
    )
    assert [got[c] for c in "abcdef"] == [False, True, True, True, None, None]
    assert [got[c] for c in "ghij"] == ["Hello World", "210", "1234567890", "none\ntrue\nfalse\na"]


SHIFTS = [
    ("2020-02-01T17:22:45Z", 6, "month", "2020-08-01T17:22:45Z"), ("2021-03-31T00:00:00+02:00", -7, "day", "2021-03-24T00:00:00+02:00"), ("2020-02-29T17:22:45Z", 1, "year", "2021-02-28T17:22:45Z"), ("2020-01-31", 1, "month", "2020-02-29"),
    ("2016-12-31T23:59:59Z", 1, "second", "2017-01-01T00:00:00Z"), ("2018-12-31T17:22:45Z", 1150, "millisecond", "2018-12-31T17:22:46.150Z"), ("2018-01-01", 25, "hour", "2018-01-02"), ("2018-01-01", -1, "hour", "2017-12-31"),
    ("2019-05-15T10:00:00Z", 1, "month", "2019-06-15T10:00:00Z"), ("2019-01-31", 1, "month", "2019-02-28"),
]


def test_dates(spark):
    got = values(spark, **{f"s{i}": S.date_shift(F.lit(d), n, u) for i, (d, n, u, _) in enumerate(SHIFTS)})
    assert list(got.values()) == [x[3] for x in SHIFTS]
    got = values(
        spark, a=S.date_difference("2020-01-01T00:00:00.0Z", "2020-01-01T00:00:15.5Z"), b=S.date_difference("2020-01-01T00:00:00Z", "2020-01-01T01:00:00+01:00"), c=S.date_difference("2020-01-02", "2020-01-01"), d=S.date_difference("2020-01-02", "2020-01-01", "day"),
        e=S.date_between("2020-01-01", "2021-01-01", "2022-01-01"), f=S.date_difference("2020-01-31", "2020-02-01", "month"), g=S.date_difference("2019-12-31", "2020-01-01", "year"),
    )
    assert list(got.values()) == [15.5, 0, -86400, -1, False, 1, 1]
    with pytest.raises(ValueError):
        S.date_shift("2020-01-01", 1, "eon")


LONG = [6, -1, 2, None, 7, 4, None, 8, 3, 9, 9]


def arr(x):
    return F.array(*[F.lit(v).cast("double") for v in x])


def test_order_and_sort(spark):
    a = arr(LONG)
    got = values(
        spark, a=A.order(a), b=A.order(a, nodata=True), c=A.order(a, asc=False, nodata=True), d=A.order(a, nodata=False), e=A.sort(a), f=A.sort(a, False, True), g=A.sort(a, nodata=False),
        h=A.rearrange(arr([5, 4, 3, 2]), [1, 3]),
    )
    assert got["a"] == [1, 2, 8, 5, 0, 4, 7, 9, 10]
    assert got["b"] == [1, 2, 8, 5, 0, 4, 7, 9, 10, 3, 6]
    assert got["c"] == [6, 3, 10, 9, 7, 4, 0, 5, 8, 2, 1]
    assert got["d"][:2] == [3, 6]
    assert got["e"] == [-1, 2, 3, 4, 6, 7, 8, 9, 9] and got["f"][-2:] == [None, None] and got["f"][:2] == [9, 9] and got["g"][:2] == [None, None]
    assert got["h"] == [4, 2]


def test_arrays(spark):
    a = arr([9, 8, 7, 6, 5])
    labeled = A.array_create_labeled(arr([1, 2, 3]), ["a", "b", "c"])
    got = values(
        spark, a=A.array_element(a, 2), b=A.array_element(a, -1), c=A.array_element(a, 99, return_nodata=True), d=A.array_element(labeled, label="b", labeled=True), e=A.array_create([1, 2], 3), f=A.array_modify(a, arr([1, 1]), 1, 2), g=A.array_concat(arr([1]), arr([2, 3])),
        h=A.array_append(arr([1]), F.lit(2.0)), i=A.array_contains(a, 7), j=A.array_contains(a, None), k=A.array_find(arr([1, 0, 3, 2, 3]), 3.0), l=A.array_find(arr([1, 0, 3, 2, 3]), 3.0, True), m=A.array_find(a, 99.0), n=A.array_find_label(labeled, "c"),
        o=A.array_labels(a), p=A.array_labels(labeled, True), q=A.array_interpolate_linear(arr([None, 1, None, 4, None, 7, None])), r=A.array_find(a, float("nan")), s=A.array_filter(a, lambda x: x > 6), t=A.array_apply(a, lambda x: x * 2),
    )
    assert [got[c] for c in "abcd"] == [7, 5, None, 2]
    assert got["e"] == [1, 2] * 3 and got["f"] == [9, 1, 1, 6, 5] and got["g"] == [1, 2, 3] and got["h"] == [1, 2]
    assert [got[c] for c in "ijklmn"] == [True, False, 2, 4, 999999, 2]
    assert got["o"] == [0, 1, 2, 3, 4] and got["p"] == ["a", "b", "c"] and got["q"] == [None, 1, 2.5, 4, 5.5, 7, None] and got["r"] == 999999
    assert got["s"] == [9, 8, 7] and got["t"] == [18, 16, 14, 12, 10]
    with pytest.raises(ArrayElementParameterMissing):
        A.array_element(a)
    with pytest.raises(ArrayElementParameterConflict):
        A.array_element(a, 1, "x")


def test_array_reducers(spark):
    from gridloom.functions import reducers as R

    a, none, empty = arr([5, 1, None, 3]), arr([None, None]), F.array().cast("array<double>")
    got = values(
        spark, a=R._sum(a), b=R._sum(none), c=R._sum(empty), d=R.product(none), e=R._min(a, ignore_nodata=False), f=R.mean(a), g=R.median(a), h=R.sd(a), i=R.quantiles(arr([2, 4, 4, 4, 5, 5, 7, 9]), [0.005, 0.01, 0.5]), j=R.quantiles(arr([2, 4, 4, 4, 5, 5, 7, 9]), q=4),
        k=R.extrema(a), l=R.count(a), m=R.count(a, True), n=R.first(arr([None, 2, 3])), o=R.last(arr([1, 2, None])), p=R.first(arr([None, 2]), ignore_nodata=False), q=R._any(arr([None, 1])), r=R._any(arr([None, 0]), ignore_nodata=False), s=R._all(arr([None, 1])), t=R._all(empty),
        u=R.cumsum(arr([1, None, 3])), v=R.cumsum(arr([1, None, 3]), ignore_nodata=False), w=R.cumproduct(arr([2, 3])), x=R.cummin(arr([5, None, 3, 6])), y=R.cummax(arr([5, None, 3, 6])), z=R.variance(arr([1])),
    )
    assert [got[c] for c in "abcde"] == [9, 0, None, 1, None]
    assert got["f"] == 3 and got["g"] == 3 and got["h"] == 2
    assert [round(v, 3) for v in got["i"]] == [2.07, 2.14, 4.5] and got["j"] == [4, 4.5, 5.5]
    assert got["k"] == [1, 5] and (got["l"], got["m"], got["n"], got["o"], got["p"]) == (3, 4, 2, 2, None)
    assert (got["q"], got["r"], got["s"], got["t"]) == (True, None, True, None)
    assert got["u"] == [1, None, 4] and got["v"] == [1, None, None] and got["w"] == [2, 6] and got["x"] == [5, None, 3, 3] and got["y"] == [5, None, 5, 6] and got["z"] is None
    with pytest.raises(QuantilesParameterMissing):
        A.quantile_points()
    with pytest.raises(QuantilesParameterConflict):
        A.quantile_points([0.1], 2)
