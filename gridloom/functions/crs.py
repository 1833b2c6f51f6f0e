"""Reference systems in closed form: geographic (WGS 84, ETRS89), Web Mercator, UTM zones (Krüger's series), and the conic and equal-area systems in SYSTEMS.

ETRS89 and RGF93 are taken as WGS 84, from which they differ by less than a metre.
"""

from __future__ import annotations

import math
import re

from gridloom.errors import CrsNotSupported
from gridloom.schema import BBox

RADIUS, FLAT = 6378137.0, 1 / 298.257223563
ECC = math.sqrt(FLAT * (2 - FLAT))
# Geographic systems, and by EPSG number the projection with its parameters. lcc (Lambert's conformal conic): latitudes of both standard parallels, latitude and longitude of the origin,
# easting and northing there. laea (Lambert's azimuthal equal area): latitude and longitude of the origin, easting and northing there.
GEOGRAPHIC = {4326, 4258, 4171}
SYSTEMS = {
    2154: ("lcc", 44.0, 49.0, 46.5, 3.0, 700000.0, 6600000.0),
    3034: ("lcc", 35.0, 65.0, 52.0, 10.0, 4000000.0, 2800000.0),
    3035: ("laea", 52.0, 10.0, 4321000.0, 3210000.0),
}


def code(crs) -> int:
    """EPSG number of a number, 'EPSG:n', an OGC URN or a WKT text of one of the known systems."""
    if isinstance(crs, int):
        return crs
    text = str(crs)
    if text.upper().endswith("CRS84") or text.upper() in ("WGS84", "OGC:CRS84"):
        return 4326
    if m := re.search(r"(?:EPSG|epsg)\W+(?:\d+(?:\.\d+)*:)?(?:[\d.]*:)?(\d{4,5})\W*$", text):
        return int(m[1])
    if "Pseudo-Mercator" in text or "Pseudo Mercator" in text:
        return 3857
    if m := re.search(r"UTM zone (\d+)([NS])", text):
        return (32600 if m[2] == "N" else 32700) + int(m[1])
    if text.isdigit():
        return int(text)
    raise CrsNotSupported(text)


def same_crs(a, b) -> bool:
    return code(a) == code(b)


def is_geographic(crs) -> bool:
    return code(crs) in GEOGRAPHIC


def _zone(c: int) -> tuple[int, bool] | None:
    if 25828 <= c <= 25838:  # on ETRS89
        return c % 100, True
    return (c % 100, c < 32700) if 32601 <= c <= 32660 or 32701 <= c <= 32760 else None


class Ops:
    """The functions that a projection needs, for floats; gridloom.functions.projection has them for columns."""

    sin, cos, tan, atan, atan2, sinh, cosh, atanh, asinh, exp, log, sqrt = (staticmethod(getattr(math, n)) for n in "sin cos tan atan atan2 sinh cosh atanh asinh exp log sqrt".split())

    @staticmethod
    def let(value, body):
        """body(value); for columns the value is computed once."""
        return body(value)


def _series() -> tuple[float, tuple, tuple]:
    n = FLAT / (2 - FLAT)
    a = RADIUS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forth = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    back = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    return a, forth, back


def _isometric(phi, m):
    return m.atanh(m.sin(phi)) - m.atanh(m.sin(phi) * ECC) * ECC


def _lcc(lat1, lat2, lat0, lon0, east, north):
    """Both ways of a conformal conic with two standard parallels."""
    rad = math.pi / 180
    p1, p2 = lat1 * rad, lat2 * rad
    width = lambda p: math.cos(p) / math.sqrt(1 - (ECC * math.sin(p)) ** 2)
    psi1, psi2 = _isometric(p1, Ops), _isometric(p2, Ops)
    n = math.log(width(p1) / width(p2)) / (psi2 - psi1)
    scale = RADIUS * width(p1) / n * math.exp(n * psi1)
    origin = scale * math.exp(-n * _isometric(lat0 * rad, Ops))

    def forth(lon, lat, m):
        r = m.exp(_isometric(lat * rad, m) * -n) * scale
        turn = (lon - lon0) * (rad * n)
        return r * m.sin(turn) + east, r * m.cos(turn) * -1.0 + (origin + north)

    def back(x, y, m):
        dx, dy = x - east, y * -1.0 + (origin + north)
        psi = m.log(m.sqrt(dx * dx + dy * dy) / scale) * (-1 / n)

        def closer(phi, steps):
            if not steps:
                return phi
            return m.let(m.atan(m.sinh(psi + m.atanh(m.sin(phi) * ECC) * ECC)), lambda p: closer(p, steps - 1))

        return m.atan2(dx, dy) * (1 / (rad * n)) + lon0, closer(m.atan(m.sinh(psi)), 5) * (1 / rad)

    return forth, back


def _laea(lat0, lon0, east, north):
    """Both ways of an azimuthal equal-area projection about a point; the way back is good to a few millimetres."""
    rad, e2 = math.pi / 180, ECC**2

    def share(s, m):
        """Of the area from the equator to the latitude of this sine, on the scale of the authalic sphere."""
        return (s / (s * s * -e2 + 1) + m.atanh(s * ECC) * (1 / ECC)) * (1 - e2)

    whole = share(1.0, Ops)
    s1 = share(math.sin(lat0 * rad), Ops) / whole
    c1 = math.sqrt(1 - s1 * s1)
    sphere = RADIUS * math.sqrt(whole / 2)
    stretch = RADIUS * math.cos(lat0 * rad) / math.sqrt(1 - e2 * math.sin(lat0 * rad) ** 2) / (sphere * c1)

    def forth(lon, lat, m):
        s = share(m.sin(lat * rad), m) * (1 / whole)
        c = m.sqrt(s * s * -1.0 + 1)
        turn = (lon - lon0) * rad
        size = m.sqrt((s * s1 + c * m.cos(turn) * c1 + 1) * 0.5)
        return c * m.sin(turn) / size * (sphere * stretch) + east, (s * c1 - c * m.cos(turn) * s1) / size * (sphere / stretch) + north

    def back(x, y, m):
        dx, dy = (x - east) * (1 / stretch), (y - north) * stretch
        half = (dx * dx + dy * dy) * (1 / (4 * sphere * sphere))  # the square of the sine of half the angle at the centre
        k, c = m.sqrt(half * -1.0 + 1) * (1 / sphere), half * -2.0 + 1
        s = c * s1 + dy * k * c1
        beta = m.atan2(s, m.sqrt(s * s * -1.0 + 1))
        phi = beta + m.sin(beta * 2) * (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040) + m.sin(beta * 4) * (23 * e2**2 / 360 + 251 * e2**3 / 3780) + m.sin(beta * 6) * (761 * e2**3 / 45360)
        return m.atan2(dx * k, c * c1 - dy * k * s1) * (1 / rad) + lon0, phi * (1 / rad)

    return forth, back


def from_degrees(lon, lat, crs, m=Ops):
    c = code(crs)
    if c in GEOGRAPHIC:
        return lon, lat
    if c in SYSTEMS:
        kind, *given = SYSTEMS[c]
        return (_lcc if kind == "lcc" else _laea)(*given)[0](lon, lat, m)
    rad = math.pi / 180
    if c == 3857:
        return lon * (RADIUS * rad), m.log(m.tan(lat * (rad / 2) + math.pi / 4)) * RADIUS
    if not (zone := _zone(c)):
        raise CrsNotSupported(str(crs))
    a, forth, _ = _series()
    ecc = math.sqrt(FLAT * (2 - FLAT))
    phi, lam = lat * rad, (lon - (zone[0] * 6 - 183)) * rad
    t = m.sinh(m.atanh(m.sin(phi)) - m.atanh(m.sin(phi) * ecc) * ecc)
    xi, eta = m.atan2(t, m.cos(lam)), m.atanh(m.sin(lam) / m.sqrt(t * t + 1))
    x, y = eta, xi
    for j, al in enumerate(forth, 1):
        x = x + m.cos(xi * (2 * j)) * m.sinh(eta * (2 * j)) * al
        y = y + m.sin(xi * (2 * j)) * m.cosh(eta * (2 * j)) * al
    return x * (0.9996 * a) + 500000.0, y * (0.9996 * a) + (0.0 if zone[1] else 1e7)


def to_degrees(x, y, crs, m=Ops):
    c = code(crs)
    if c in GEOGRAPHIC:
        return x, y
    if c in SYSTEMS:
        kind, *given = SYSTEMS[c]
        return (_lcc if kind == "lcc" else _laea)(*given)[1](x, y, m)
    deg = 180 / math.pi
    if c == 3857:
        return x * (deg / RADIUS), m.atan(m.exp(y / RADIUS)) * (2 * deg) - 90
    if not (zone := _zone(c)):
        raise CrsNotSupported(str(crs))
    a, _, back = _series()
    xi, eta = (y - (0.0 if zone[1] else 1e7)) / (0.9996 * a), (x - 500000.0) / (0.9996 * a)
    p, q = xi, eta
    for j, b in enumerate(back, 1):
        p = p - m.sin(xi * (2 * j)) * m.cosh(eta * (2 * j)) * b
        q = q - m.cos(xi * (2 * j)) * m.sinh(eta * (2 * j)) * b
    tau = m.sin(p) / m.sqrt(m.sinh(q) * m.sinh(q) + m.cos(p) * m.cos(p))
    ecc = math.sqrt(FLAT * (2 - FLAT))

    def newton(t, goal):
        """A step to the geodetic latitude."""
        s = m.sinh(m.atanh(t / m.sqrt(t * t + 1) * ecc) * ecc)
        own = m.let(s, lambda v: t * m.sqrt(v * v + 1) - v * m.sqrt(t * t + 1))
        return m.let(own, lambda u: t + (goal - u) / m.sqrt(u * u + 1) * (t * t * (1 - ecc**2) + 1) / (m.sqrt(t * t + 1) * (1 - ecc**2)))

    def latitude(goal):
        return m.let(m.let(newton(goal, goal), lambda t: newton(t, goal)), lambda t: m.atan(newton(t, goal)) * deg)

    return m.atan2(m.sinh(q), m.cos(p)) * deg + (zone[0] * 6 - 183), m.let(tau, latitude)


def transform(x, y, source, target, m=Ops):
    if same_crs(source, target):
        return x, y
    return from_degrees(*to_degrees(x, y, source, m), target, m)


def reproject_bbox(box: BBox, target) -> BBox:
    """The box around the four corners."""
    corners = [transform(x, y, box.crs, target) for x in (box.west, box.east) for y in (box.south, box.north)]
    xs, ys = zip(*corners)
    return BBox(min(xs), min(ys), max(xs), max(ys), target)
