"""Polygons and points from GeoJSON, and point-in-polygon tests as Column expressions, as joins, or on the driver."""

from __future__ import annotations

import json
import math
import urllib.request
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import crs as C

Ring = list[tuple[float, float]]
#: Edges up to which a test is one expression; for more, points are joined with the edges of their strip.
FEW_EDGES = 64
#: Edges of a strip, about, and strips at most.
STRIP_EDGES, STRIPS = 8, 1 << 16
EDGE = "geometry long, x0 double, y0 double, x1 double, y1 double"


def crs_of(data: dict) -> str | int:
    given = data.get("crs")
    if isinstance(given, dict):
        return given.get("properties", {}).get("name", "EPSG:4326")
    return given if given is not None else "EPSG:4326"


def polygons_of(geometry: dict | None) -> list[list[Ring]]:
    """The polygons of a geometry, each as its rings: the outer one, then holes."""
    if not geometry:
        return []
    kind = geometry.get("type")
    if kind == "Feature":
        return polygons_of(geometry.get("geometry"))
    if kind == "FeatureCollection":
        return [p for f in geometry["features"] for p in polygons_of(f)]
    if kind == "GeometryCollection":
        return [p for g in geometry["geometries"] for p in polygons_of(g)]
    if kind == "Polygon":
        return [[[(float(p[0]), float(p[1])) for p in ring] for ring in geometry["coordinates"]]]
    if kind == "MultiPolygon":
        return [[[(float(p[0]), float(p[1])) for p in ring] for ring in poly] for poly in geometry["coordinates"]]
    return []


@dataclass
class Shapes:
    """Query geometries on the driver: each is a list of polygons. They are the (bounded) query, not data."""

    parts: list[list[list[Ring]]]
    crs: str | int = "EPSG:4326"
    properties: list[dict] = field(default_factory=list)

    @staticmethod
    def of(data, target=None) -> Shapes:
        """From Shapes, GeoJSON (dict or text), or a path or address of one; brought to the target system if given."""
        if isinstance(data, Shapes):
            out = data
        else:
            if isinstance(data, str):
                data = json.loads(data if data.lstrip().startswith("{") else fetched(data))
            kind = data.get("type")
            if kind == "FeatureCollection":
                found = [(polygons_of(f), f.get("properties") or {}) for f in data["features"]]
            elif kind in ("Polygon", "MultiPolygon", "Feature", "GeometryCollection"):
                found = [(polygons_of(data), data.get("properties") or {})]
            else:
                raise ValueError(f"no polygons in {kind}")
            out = Shapes([p for p, _ in found], crs_of(data), [q for _, q in found])
        if target is None or C.same_crs(out.crs, target):
            return out
        moved = [[[[C.transform(x, y, out.crs, target) for x, y in ring] for ring in poly] for poly in shape] for shape in out.parts]
        return Shapes(moved, target, out.properties)

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        points = [p for shape in self.parts for poly in shape for ring in poly for p in ring]
        return min(x for x, _ in points), min(y for _, y in points), max(x for x, _ in points), max(y for _, y in points)

    def edges(self) -> list[tuple[int, float, float, float, float]]:
        """(shape, both ends) of all edges that aren't level; crossings of them count, whatever ring they are of."""
        return [(i, *e) for i, shape in enumerate(self.parts) for poly in shape for e in edges_of(poly)]

    def rings(self) -> list[tuple[int, list[list[list[float]]]]]:
        """(shape, all rings of all its polygons); even-odd over them honours holes and many parts."""
        return [(i, [[list(p) for p in ring] for poly in shape for ring in poly]) for i, shape in enumerate(self.parts)]


def fetched(address: str) -> bytes:
    """What stands at a path or an address."""
    if "://" not in address:
        with open(address, "rb") as f:
            return f.read()
    with urllib.request.urlopen(address) as answer:
        return answer.read()


def edges_of(polygon: list[Ring]) -> list[tuple[float, float, float, float]]:
    return [(*a, *b) for ring in polygon for a, b in zip(ring, [*ring[1:], ring[0]]) if a[1] != b[1]]


def edge_table(spark: SparkSession, geometries, target=None) -> tuple[DataFrame, DataFrame]:
    """(edges: EDGE; geometry ids) of Shapes and what they are made of, or of a vector cube, whose geometries stay distributed."""
    if not hasattr(geometries, "df"):
        shapes = Shapes.of(geometries, target)
        ids = spark.range(len(shapes.parts)).select(F.col("id").alias("geometry"))
        return spark.createDataFrame(shapes.edges(), EDGE), ids
    source = geometries.crs
    move = target is not None and not C.same_crs(source, target)

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for i, text in zip(frame["geom_id"], frame["geometry"]):
                for poly in polygons_of(json.loads(text)) if text else []:
                    if move:
                        poly = [[C.transform(x, y, source, target) for x, y in ring] for ring in poly]
                    rows += [(i, *e) for e in edges_of(poly)]
            yield pd.DataFrame(rows, columns=["geometry", "x0", "y0", "x1", "y1"])

    ids = geometries.df.select(F.col("geom_id").cast("long").alias("geometry"))
    return geometries.df.select(F.col("geom_id").cast("long"), "geometry").mapInPandas(run, EDGE), ids


def covering(points: DataFrame, x: str, y: str, edges: DataFrame) -> DataFrame:
    """(geometry, x, y): the points that lie in each geometry, by the even-odd rule.

    The plane is cut into level strips; a point meets the edges of its own strip only, in an equi-join, and the edges that a ray from it
    crosses are counted. So neither points nor edges are gathered, and an outline of many edges is no problem for planning.
    """
    n, south, north = edges.agg(F.count("*"), F.min(F.least("y0", "y1")), F.max(F.greatest("y0", "y1"))).first()
    strips = max(1, min(STRIPS, n // STRIP_EDGES))
    height = (north - south) / strips if n else 1.0
    low = float(south or 0.0)

    def strip(c: Column) -> Column:
        return F.floor((c - low) / (height or 1.0)).cast("int")

    cut = edges.withColumn("_strip", F.explode(F.sequence(strip(F.least("y0", "y1")), strip(F.greatest("y0", "y1")))))
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    near = points.select(x, y).filter(py.between(low, float(north or 0.0))).distinct().withColumn("_strip", strip(py))
    crosses = ((F.col("y0") > py) != (F.col("y1") > py)) & (px < (F.col("x1") - F.col("x0")) * (py - F.col("y0")) / (F.col("y1") - F.col("y0")) + F.col("x0"))
    return near.join(cut, "_strip").filter(crosses).groupBy("geometry", x, y).agg(F.count("*").alias("_n")).filter("_n % 2 = 1").select("geometry", x, y)


def inside(x: Column, y: Column, rings: Column) -> Column:
    """Even-odd rule over array<array<array<double>>>: rings of (x, y) points; the last point may repeat the first."""

    def crossings(ring: Column) -> Column:
        edge = F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(F.size(ring), F.lit(1))), F.slice(ring, 1, 1)), lambda a, b: F.struct(a[0].alias("x0"), a[1].alias("y0"), b[0].alias("x1"), b[1].alias("y1")))
        hit = F.filter(edge, lambda e: ((e["y0"] > y) != (e["y1"] > y)) & (x < (e["x1"] - e["x0"]) * (y - e["y0"]) / F.nullif(e["y1"] - e["y0"], F.lit(0.0)) + e["x0"]))
        return F.size(hit)

    return F.aggregate(F.transform(rings, crossings), F.lit(0), lambda s, n: s + n) % 2 == 1


def inside_fixed(x: Column, y: Column, ring: Ring) -> Column:
    """The same for one ring that is known when the query is built: plain arithmetic, which compiles with the scan."""
    out = F.lit(False)
    for (x0, y0), (x1, y1) in zip(ring, [*ring[1:], ring[0]]):
        if y0 != y1:
            cross = (F.lit(y0) > y) != (F.lit(y1) > y)
            out = out != F.coalesce(cross & (x < (F.lit(x1) - x0) * (y - y0) / F.lit(y1 - y0) + x0), F.lit(False))
    return out


def area_signed(ring: Ring) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], ring[0]])) / 2


def segments_cross(a, b, c, d) -> bool:
    def side(p, q, r):
        return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

    return side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0


def contains(ring: Ring, p) -> bool:
    out = False
    for (x0, y0), (x1, y1) in zip(ring, [*ring[1:], ring[0]]):
        if (y0 > p[1]) != (y1 > p[1]) and p[0] < (x1 - x0) * (p[1] - y0) / (y1 - y0) + x0:
            out = not out
    return out


def overlap(a: list[list[Ring]], b: list[list[Ring]]) -> bool:
    """Whether two shapes share more than a border: edges cross, or an inner point of one lies in the other."""
    for p in a:
        for q in b:
            edges = [[(s, t) for s, t in zip(r[0], [*r[0][1:], r[0][0]])] for r in (p, q)]
            if any(segments_cross(*s, *t) for s in edges[0] for t in edges[1]):
                return True
            for own, other in ((p[0], q[0]), (q[0], p[0])):
                n = len(set(own))
                middle = (sum(x for x, _ in set(own)) / n, sum(y for _, y in set(own)) / n)
                if contains(own, middle) and contains(other, middle):
                    return True
    return False


def buffered(polygon: list[Ring], distance: float, quarter: int = 16) -> list[Ring]:
    """A polygon (outer ring) grown by a distance, with round corners: offset edges and arcs at convex corners."""
    ring = polygon[0][:-1] if len(polygon[0]) > 1 and polygon[0][0] == polygon[0][-1] else polygon[0]
    if len(ring) == 1:
        x, y = ring[0]
        n = 4 * quarter
        circle = [(x + distance * math.cos(2 * math.pi * k / n), y + distance * math.sin(2 * math.pi * k / n)) for k in range(n)]
        return [[*circle, circle[0]]]
    if area_signed(ring) < 0:
        ring = ring[::-1]
    out: Ring = []
    n = len(ring)
    for i in range(n):
        p, q, r = ring[i - 1], ring[i], ring[(i + 1) % n]
        a0 = math.atan2(q[0] - p[0], -(q[1] - p[1])) + math.pi
        a1 = math.atan2(r[0] - q[0], -(r[1] - q[1])) + math.pi
        turn = (a1 - a0 + math.pi) % (2 * math.pi) - math.pi
        if turn >= 0:
            steps = max(1, math.ceil(turn / (math.pi / 2) * quarter))
            out += [(q[0] + distance * math.cos(a0 + turn * k / steps), q[1] + distance * math.sin(a0 + turn * k / steps)) for k in range(steps + 1)]
        else:  # a reflex corner: the offset edges meet
            half = (a0 + a1) / 2 if abs(a1 - a0) <= math.pi else (a0 + a1) / 2 + math.pi
            d = distance / max(math.cos(turn / 2), 0.1)
            out.append((q[0] + d * math.cos(half), q[1] + d * math.sin(half)))
    return [[*out, out[0]]]
