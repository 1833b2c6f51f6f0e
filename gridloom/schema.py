"""Dimensions of a cube and what is known about them on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime

from gridloom.errors import DimensionMissing, DimensionNotAvailable, TooManyDimensions

# Dimension names by type; case doesn't count.
NAMES = {
    "temporal": {"date", "time", "t", "year", "quarter", "month", "week", "day", "hour", "second"},
    "x": {"x", "lon", "longitude"},
    "y": {"y", "lat", "latitude"},
    "bands": {"b", "bands", "band"},
}
VALUE = "value"


def guess_type(name: str) -> str:
    """temporal, x, y, bands or other, from the name of a dimension."""
    return next((kind for kind, names in NAMES.items() if name.casefold() in names), "other")


@dataclass(frozen=True)
class BBox:
    west: float
    south: float
    east: float
    north: float
    crs: str | int = "EPSG:4326"


@dataclass(frozen=True)
class Interval:
    start: datetime | str | None
    end: datetime | str | None


@dataclass(frozen=True)
class Dim:
    """labels: the ordered labels if they are few and known (bands); None for those that live in the data."""

    name: str
    type: str
    labels: tuple | None = None


@dataclass(frozen=True)
class CubeSchema:
    dims: tuple[Dim, ...]
    crs: str | int | None = None
    attrs: dict = field(default_factory=dict)
    common_names: dict = field(default_factory=dict)  # band label -> common name

    @property
    def names(self) -> list[str]:
        return [d.name for d in self.dims]

    def dim(self, name: str) -> Dim:
        for d in self.dims:
            if d.name == name:
                return d
        raise DimensionNotAvailable(f"no dimension {name!r}; there are {self.names}")

    def of_type(self, kind: str) -> list[Dim]:
        return [d for d in self.dims if d.type == kind]

    def only(self, kind: str, given: str | None = None) -> Dim:
        """The dimension named, or the one of that type."""
        if given is not None:
            return self.dim(given)
        found = self.of_type(kind)
        if not found:
            raise DimensionNotAvailable(f"no {kind} dimension")
        if len(found) > 1:
            raise TooManyDimensions(f"several {kind} dimensions: {[d.name for d in found]}")
        return found[0]

    @property
    def spatial(self) -> list[Dim]:
        """x before y."""
        return [*self.of_type("x"), *self.of_type("y")]

    @property
    def band(self) -> Dim:
        found = self.of_type("bands")
        if not found:
            raise DimensionMissing("no band dimension")
        return found[0]

    def without(self, *names: str) -> CubeSchema:
        return replace(self, dims=tuple(d for d in self.dims if d.name not in names))

    def put(self, dim: Dim) -> CubeSchema:
        """With that dimension in place of the one of its name."""
        return replace(self, dims=tuple(dim if d.name == dim.name else d for d in self.dims))

    def typed(self, name: str, kind: str) -> CubeSchema:
        """Sets the type of a dimension: x, y, temporal, bands or other; it stays through later operations."""
        if kind not in ("x", "y", "temporal", "bands", "other"):
            raise ValueError(f"unknown type of dimension: {kind}")
        return self.put(replace(self.dim(name), type=kind))


def schema_of(names: list[str], bands: list | None = None, crs=None, attrs: dict | None = None) -> CubeSchema:
    dims = []
    for n in names:
        kind = guess_type(n)
        dims.append(Dim(n, kind, tuple(bands) if kind == "bands" and bands is not None else None))
    return CubeSchema(tuple(dims), crs, attrs or {})
