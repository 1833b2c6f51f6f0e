"""Projections of coordinate columns, with the same formulas as for floats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions import crs


class ColumnOps:
    sin, cos, tan, atan, atan2, sinh, cosh, atanh, asinh, exp, log, sqrt = (staticmethod(getattr(F, n)) for n in "sin cos tan atan atan2 sinh cosh atanh asinh exp log sqrt".split())

    @staticmethod
    def let(value: Column, body) -> Column:
        return F.transform(F.array(value), body)[0]


def transform(x: Column, y: Column, source, target) -> tuple[Column, Column]:
    return crs.transform(x, y, source, target, ColumnOps)
