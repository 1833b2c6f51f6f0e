"""Merging cubes: a union, a full outer join, an inner join or a broadcast-like join, by how dimensions and labels relate."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from gridloom.errors import OverlapResolverMissing
from gridloom.schema import VALUE, Dim

METHODS = ("merge_cubes",)
CUBES = "__cubes__"
SNAP = 1e-6


def _resolved(resolver, x, y, context):
    return resolver(x, y, context) if context is not None else resolver(x, y)


def _aligned(one, two):
    """two, with its float labels moved to those of one where they differ by less than SNAP; by place, dimension by dimension."""
    df = two.df
    for d in one.schema.dims:
        if d.name not in two.dims or one.df.schema[d.name].dataType.typeName() not in ("double", "float"):
            continue
        # labels are matched by their rounded value: neighbours in a grid are much further apart than SNAP
        key = F.round(F.col(d.name) / SNAP)
        own = one.label_table(d.name).select(F.col(d.name).alias("_to"), key.alias("_k"))
        near = own.select("_to", F.explode(F.array(F.col("_k") - 1, F.col("_k"), F.col("_k") + 1)).alias("_k"))
        theirs = two.label_table(d.name).withColumn("_k", key).join(near, "_k").filter(F.abs(F.col("_to") - F.col(d.name)) < SNAP)
        moves = theirs.groupBy(d.name).agg(F.min_by("_to", F.abs(F.col("_to") - F.col(d.name))).alias("_to")).filter(F.col("_to") != F.col(d.name))
        df = df.join(moves, d.name, "left").withColumn(d.name, F.coalesce("_to", d.name)).drop("_to")
    return type(two)(df.select(*two.dims, VALUE), two.schema)


def _relations(one, two, names: list[str]) -> dict[str, str]:
    """equal, disjoint or partial, of the labels along each shared dimension: from the declared labels, else counted by Spark, all in one job."""
    counts, tables = {}, None
    for name in names:
        a, b = one.schema.dim(name).labels, two.schema.dim(name).labels
        if a is not None and b is not None:
            counts[name] = len(set(a) & set(b)), len(set(a) | set(b))
            continue
        for cube, side in ((one, 1), (two, 2)):
            rows = cube.label_table(name).select(F.lit(name).alias("dim"), F.struct(F.col(name).cast("string").alias("label"), F.col(name).isNull().alias("none")).alias("label"), F.lit(side).alias("side"))
            tables = rows if tables is None else tables.union(rows)
    if tables is not None:
        each = tables.groupBy("dim", "label").agg(F.count_distinct("side").alias("sides"))
        for r in each.groupBy("dim").agg(F.count_if(F.col("sides") == 2).alias("common"), F.count("*").alias("every")).collect():
            counts[r["dim"]] = r["common"], r["every"]
    common = {n: counts.get(n, (0, 0)) for n in names}
    return {n: "equal" if c == every else "disjoint" if c == 0 else "partial" for n, (c, every) in common.items()}


def merge_cubes(cube1, cube2, overlap_resolver=None, context=None):
    """Joins two cubes.

    Same dimensions, labels equal: cell by cell through the resolver, or without one a new dimension that tells the cubes
    apart. One dimension that overlaps in part: the resolver where both have a cell. No overlap: the union. One or two
    dimensions missing in one cube: that cube is spread over them.
    """
    if type(cube1) is not type(cube2):
        raise TypeError("cubes of different kinds")
    cube2 = _aligned(cube1, cube2)
    only1, only2 = [d for d in cube1.dims if d not in cube2.dims], [d for d in cube2.dims if d not in cube1.dims]
    if not only1 and not only2:
        return _same(cube1, cube2, overlap_resolver, context)
    if only1 and only2 or len(only1) + len(only2) > 2:
        raise ValueError(f"cubes differ by too many dimensions: {only1 + only2}")
    if overlap_resolver is None:
        raise OverlapResolverMissing
    wide, narrow = (cube1, cube2) if only1 else (cube2, cube1)
    other = narrow.df.withColumnRenamed(VALUE, "_other")
    shared = narrow.dims
    # Spark broadcasts the narrow side where its size allows, else both sides meet on the shared labels.
    joined = wide.df.join(other, shared, "inner") if shared else wide.df.crossJoin(other)
    x, y = (F.col(VALUE), F.col("_other")) if wide is cube1 else (F.col("_other"), F.col(VALUE))
    return type(cube1)(joined.select(*wide.dims, _resolved(overlap_resolver, x, y, context).alias(VALUE)), wide.schema)


def _same(cube1, cube2, resolver, context):
    dims = cube1.dims
    relation = _relations(cube1, cube2, dims)
    partial = [d for d, r in relation.items() if r == "partial"]
    disjoint = [d for d, r in relation.items() if r == "disjoint"]
    if len(partial) > 1:
        raise ValueError(f"several dimensions overlap in part: {partial}")
    schema = cube1.schema
    for d in schema.dims:
        b = cube2.schema.dim(d.name).labels
        if d.labels is not None and b is not None:
            schema = schema.put(replace(d, labels=(*d.labels, *(x for x in b if x not in d.labels))))
    if disjoint:
        out = type(cube1)(cube1.df.select(*dims, VALUE).unionByName(cube2.df.select(*dims, VALUE)), schema)
        return out.densify() if len(disjoint) > 1 else out
    if not partial and resolver is None:
        both = cube1.df.withColumn(CUBES, F.lit("cube1")).unionByName(cube2.df.withColumn(CUBES, F.lit("cube2")))
        wider = replace(schema, dims=(Dim(CUBES, "other", ("cube1", "cube2")), *schema.dims))
        return type(cube1)(both.select(CUBES, *dims, VALUE), wider)
    if resolver is None:
        raise OverlapResolverMissing(f"{partial} overlap")
    a, b = cube1.df.withColumn("_a", F.lit(True)), cube2.df.select(*dims, F.col(VALUE).alias("_other"), F.lit(True).alias("_b"))
    joined = a.join(b, dims, "full" if partial else "inner")
    value = F.when(F.col("_a") & F.col("_b"), _resolved(resolver, F.col(VALUE), F.col("_other"), context)).otherwise(F.coalesce(VALUE, "_other"))
    return type(cube1)(joined.select(*dims, value.alias(VALUE)), schema)
