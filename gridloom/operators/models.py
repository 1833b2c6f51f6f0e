"""Curves, forests and user code. Only these use Python on executors, in Arrow batches, one group or batch at a time."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gridloom.errors import DimensionMismatch, ModelNotFoundException
from gridloom.schema import VALUE, Dim

METHODS = ("fit_curve", "predict_curve", "fit_regr_random_forest", "predict_random_forest", "run_udf", "rqa_trend")


def least_squares(function, x: np.ndarray, y: np.ndarray, start: np.ndarray, steps: int = 200) -> np.ndarray:
    """Levenberg-Marquardt with numeric derivatives; the start if there are fewer points than parameters."""
    p = np.array(start, float)
    if len(x) < len(p):
        return np.full(len(p), np.nan)
    damp = 1e-3
    r = y - function(x, *p)
    cost = float(r @ r)
    for _ in range(steps):
        h = 1e-7 * np.maximum(1.0, np.abs(p))
        j = np.column_stack([(function(x, *(p + h * (np.arange(len(p)) == k))) - function(x, *(p - h * (np.arange(len(p)) == k)))) / (2 * h[k]) for k in range(len(p))])
        a, g = j.T @ j, j.T @ r
        for _ in range(12):
            step = np.linalg.lstsq(a + damp * np.diag(np.maximum(np.diag(a), 1e-12)), g, rcond=None)[0]
            trial = y - function(x, *(p + step))
            new = float(trial @ trial)
            if new <= cost:
                break
            damp *= 4
        else:
            return p
        p, r, done = p + step, trial, cost - new <= 1e-14 * max(cost, 1e-300)
        cost, damp = new, max(damp / 5, 1e-12)
        if done:
            break
    return p


def _number(column, kind):
    """Time labels count in seconds."""
    return F.unix_micros(column.cast("timestamp")) / 1e6 if kind.startswith("timestamp") else column.cast("double")


def fit_curve(cube, parameters: list, function, dimension: str, ignore_nodata: bool = True):
    """Least-squares parameters of function(x, *parameters) for each series along the dimension, as dimension `param`.

    A series is one group; its length is that of the dimension.
    """
    kind = cube.df.schema[dimension].dataType.typeName()
    rest = cube.others(dimension)
    names = [f"param_{i}" for i in range(len(parameters))]
    rows = cube.df.select(*rest, _number(F.col(dimension), kind).alias("_x"), F.col(VALUE).cast("double").alias("_y"))
    schema = ", ".join(f"`{d}` {cube.df.schema[d].dataType.simpleString()}" for d in rest) + (", " if rest else "") + "param string, value double"

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_x")
        x, y = group["_x"].to_numpy(), group["_y"].to_numpy(float)
        good = ~np.isnan(y)
        p = least_squares(function, x[good], y[good], np.array(parameters, float)) if ignore_nodata or good.all() else np.full(len(names), np.nan)
        out = pd.DataFrame({"param": names, "value": p})
        for i, d in enumerate(rest):
            out.insert(i, d, group[d].iloc[0])
        return out

    grouped = rows.groupBy(*rest) if rest else rows.withColumn("_g", F.lit(0)).groupBy("_g")
    found = grouped.applyInPandas(fit, schema).withColumn(VALUE, F.nanvl(VALUE, F.lit(None)))
    dims = tuple(Dim("param", "other", tuple(names)) if d.name == dimension else d for d in cube.schema.dims)
    out = replace(cube.schema, dims=dims)
    return type(cube)(found.select(*out.names, VALUE), out)


def predict_curve(parameters, function, dimension: str, labels: list):
    """The curve of each parameter set at the labels. function(x, parameters) builds a Column; labels are numbers or times."""
    cube = parameters
    rest = cube.others("param")
    n = cube.label_count("param", 1000)
    cols = [F.max(F.when(F.col("param") == f"param_{i}", F.col(VALUE))).alias(f"_p{i}") for i in range(n)]
    wide = cube.df.groupBy(*rest).agg(*cols)
    label = F.explode(F.array(*[F.lit(x) for x in labels])).alias(dimension)
    each = wide.select(*rest, *[f"_p{i}" for i in range(n)], label)
    x = _number(F.col(dimension), each.schema[dimension].dataType.typeName())
    value = function(x, [F.col(f"_p{i}") for i in range(n)])
    dims = tuple(Dim(dimension, "temporal" if dimension == "t" else "other", None) if d.name == "param" else d for d in cube.schema.dims)
    schema = replace(cube.schema, dims=dims)
    return type(cube)(each.withColumn(VALUE, value).select(*schema.names, VALUE), schema)


def fit_regr_random_forest(predictors, target, features: list[str], label: str, num_trees: int = 100, max_variables=None, seed: int = 0):
    """A regression forest (depth 5, subsampling 0.8) from tables that share rows, or one table; Spark trains it on the cluster.

    predictors: a DataFrame with the feature columns (and the label, if target is None or names it).
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    rows = predictors if target is None else predictors.join(target, [c for c in predictors.columns if c in target.columns and c not in (*features, label)])
    rows = rows.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("label")).dropna()
    subset = {None: "auto", "all": "all", "log2": "log2", "onethird": "onethird", "sqrt": "sqrt"}.get(max_variables, str(max_variables))
    forest = RandomForestRegressor(numTrees=num_trees, maxDepth=5, subsamplingRate=0.8, featureSubsetStrategy=subset, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), forest]).fit(rows)


def predict_random_forest(cube, model=None, dimension: str = "bands", context=None):
    """The forest's value for each cell, from the labels along the feature dimension, which becomes one label."""
    model = model if model is not None else (context or {}).get("model")
    if model is None:
        raise ModelNotFoundException
    names = model.stages[0].getInputCols()
    labels = cube.labels(dimension)
    if len(labels) != len(names):
        raise DimensionMismatch(f"{len(labels)} labels for {len(names)} features")
    rest = cube.others(dimension)
    source = dict(zip(names, labels)) if not set(names) <= set(map(str, labels)) else {n: n for n in names}
    wide = cube.df.groupBy(*rest).agg(*[F.max(F.when(F.col(dimension) == source[n], F.col(VALUE).cast("double"))).alias(n) for n in names])
    out = model.transform(wide.dropna(subset=names)).select(*rest, F.lit("prediction").alias(dimension), F.col("prediction").alias(VALUE))
    schema = cube.schema.put(replace(cube.schema.dim(dimension), labels=("prediction",)))
    return type(cube)(out.select(*cube.dims, VALUE), schema)


def run_udf(cube, udf, runtime: str | None = None, context=None):
    """User code: a function on batches of cells, or source text that defines apply_datacube(cells, context).

    Cells come as a pandas frame (dimension columns and value) and must come back as one with the same columns.
    """
    if isinstance(udf, str):
        scope: dict = {}
        exec(udf, scope)  # the user's own code, as asked for
        udf = scope["apply_datacube"]
    names = [*cube.dims, VALUE]
    schema = cube.df.select(*names).schema

    def run(batches):
        for cells in batches:
            out = udf(cells, context)
            if not isinstance(out, pd.DataFrame):
                raise TypeError("user code must give one frame of cells")
            yield out[names]

    return type(cube)(cube.df.select(*names).mapInPandas(run, schema), cube.schema)


def trend_of_recurrence(y: np.ndarray, threshold: float, border: int = 10, edge: float = 1000.0) -> float:
    """RQA trend: the slope of the recurrence rate over the distance from the main diagonal, without its outermost diagonals."""
    n = len(y)
    rates = np.array([np.mean(np.abs(y[k:] - y[:-k]) <= threshold) for k in range(1, max(2, n - border))])
    if len(rates) < 2:
        return float("nan")
    d = np.arange(1, len(rates) + 1) - (len(rates) + 1) / 2
    return float(edge * (d @ (rates - rates.mean())) / (d @ d))


def rqa_trend(cube, dimension: str, threshold: float = 0.5):
    """RQA trend of each series along the dimension; missing cells are left out."""
    rest = cube.others(dimension)

    @F.pandas_udf("double")
    def trend(series: pd.Series) -> pd.Series:
        return pd.Series([trend_of_recurrence(np.asarray([v for v in s if v is not None and v == v], float), threshold) for s in series])

    cells = F.transform(F.sort_array(F.collect_list(F.struct(cube.order_of(dimension).alias("o"), F.col(VALUE).cast("double").alias("v")))), lambda s: s["v"])
    rows = cube.df.groupBy(*rest).agg(cells.alias("_s"))
    out = rows.select(*rest, F.nanvl(trend("_s"), F.lit(None)).alias(VALUE))
    return type(cube)(out, cube.schema.without(dimension))
