"""Cubes: a DataFrame with one row a cell (a column for each dimension, and value) and a schema on the driver.

Operators live in gridloom.operators and are methods here. Data are lazy; only labels of small dimensions are
looked at while a query is built, where an operator's checks need them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.schema import VALUE, CubeSchema, schema_of


@dataclass(frozen=True)
class Cube:
    df: DataFrame
    schema: CubeSchema

    @staticmethod
    def of(df: DataFrame, dims: list[str], value: str | Column = VALUE, bands: list | None = None, crs=None, attrs: dict | None = None) -> Cube:
        """A cube over df; NaN becomes NULL here, at the border."""
        v = F.col(value) if isinstance(value, str) else value
        rows = df.select(*[F.col(d) for d in dims], v.alias(VALUE))
        kind = rows.schema[VALUE].dataType.typeName()
        if kind in ("double", "float"):
            rows = rows.withColumn(VALUE, F.when(~F.isnan(VALUE), F.col(VALUE)))
        return Cube(rows, schema_of(dims, bands, crs, attrs))

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def dims(self) -> list[str]:
        return self.schema.names

    def others(self, *names: str) -> list[str]:
        return [d for d in self.dims if d not in names]

    def with_value(self, value: Column) -> Cube:
        return Cube(self.df.select(*self.dims, value.alias(VALUE)), self.schema)

    def label_table(self, dim: str) -> DataFrame:
        """The labels of a dimension as a table of one column."""
        self.schema.dim(dim)
        return self.df.select(dim).distinct()

    def label_count(self, dim: str, most: int = 1) -> int:
        """The number of labels, counted up to most + 1."""
        known = self.schema.dim(dim).labels
        return len(known) if known is not None else self.label_table(dim).limit(most + 1).count()

    def labels(self, dim: str) -> list:
        """Labels in order: the declared order if there is one, else ascending. Gathers them: for small dimensions."""
        known = self.schema.dim(dim).labels
        if known is not None:
            return list(known)
        return [r[0] for r in self.label_table(dim).orderBy(dim).collect()]

    def order_of(self, dim: str) -> Column:
        """What cells are ordered by along a dimension: the place of the label if declared, else the label."""
        known = self.schema.dim(dim).labels
        if known is None:
            return F.col(dim)
        return F.array_position(F.array(*[F.lit(x) for x in known]), F.col(dim)) - 1

    def densify(self) -> Cube:
        """Adds NULL cells for label combinations without a row."""
        grid = None
        for d in self.dims:
            t = self.label_table(d)
            grid = t if grid is None else grid.crossJoin(t)
        return Cube(grid.join(self.df, self.dims, "left").select(*self.dims, VALUE), self.schema)


def _attach() -> None:
    from gridloom.operators import aggregate, apply, dimensions, filters, indices, masks, merge, models, resample

    for module in (dimensions, filters, masks, merge, aggregate, apply, indices, resample, models):
        for name in module.METHODS:
            setattr(Cube, name, getattr(module, name))


_attach()
