"""Map projections as column expressions.

parse() reads a projection line (+proj=... +ellps=... ...) or a code that CODES or the UTM zones cover;
reproject() takes columns of coordinates from one projection to another, through geographic coordinates
and, where the datums differ, through geocentric ones with the seven parameters of +towgs84. Every step is a
projection of built-in functions, so plans stay one narrow stage. Transverse Mercator and the step from
conformal to geographic latitude go by their series in the third flattening up to its sixth power (below a nanometre within
thirty degrees of the meridian), conics by their closed forms and the same series, Albers by four Newton steps.

Coordinates beyond a projection's domain, and missing ones, are missing; an unknown projection, ellipsoid or unit is a ValueError.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Semi-major axis and inverse flattening of ellipsoids (0: a sphere).
ELLIPSOIDS = {
    "WGS84": (6378137.0, 298.257223563), "GRS80": (6378137.0, 298.257222101), "krass": (6378245.0, 298.3), "intl": (6378388.0, 297.0), "bessel": (6377397.155, 299.1528128), "clrk66": (6378206.4, 294.9786982138982),
    "airy": (6377563.396, 299.3249646), "WGS72": (6378135.0, 298.26), "sphere": (6370997.0, 0.0),
}
#: Datums by their ellipsoid; both agree with WGS84 as a frame.
DATUMS = {"WGS84": "WGS84", "NAD83": "GRS80"}
#: Metres of a unit.
UNITS = {"m": 1.0, "km": 1000.0, "ft": 0.3048, "us-ft": 1200.0 / 3937.0}
#: Lines of some codes; 326zz and 327zz are the zones of UTM.
CODES = {
    4326: "+proj=longlat +datum=WGS84", 4269: "+proj=longlat +datum=NAD83", 4284: "+proj=longlat +ellps=krass +towgs84=23.57,-140.95,-79.8,0,0.35,0.79,-0.22", 3857: "+proj=merc +a=6378137 +b=6378137 +lon_0=0 +k=1 +x_0=0 +y_0=0 +units=m",
    5070: "+proj=aea +lat_1=29.5 +lat_2=45.5 +lat_0=23 +lon_0=-96 +x_0=0 +y_0=0 +datum=NAD83", 3347: "+proj=lcc +lat_1=49 +lat_2=77 +lat_0=63.390675 +lon_0=-91.8666666666667 +x_0=6200000 +y_0=3000000 +datum=NAD83",
}
KINDS = {"longlat": "longlat", "latlong": "longlat", "latlon": "longlat", "lonlat": "longlat", "tmerc": "tmerc", "etmerc": "tmerc", "utm": "tmerc", "lcc": "lcc", "aea": "aea", "merc": "merc"}
ARC_SECOND = math.pi / 648000.0


@dataclass(frozen=True)
class Projection:
    """A projection; angles in radians, lengths in metres but for false origins, which are in metres too."""

    kind: str
    a: float
    f: float
    lat_0: float = 0.0
    lon_0: float = 0.0
    lat_1: float = 0.0
    lat_2: float = 0.0
    k: float = 1.0
    x_0: float = 0.0
    y_0: float = 0.0
    unit: float = 1.0
    shift: tuple[float, ...] = (0.0,) * 7

    @property
    def e2(self) -> float:
        return self.f * (2 - self.f)

    @property
    def e(self) -> float:
        return math.sqrt(self.e2)

    @property
    def n(self) -> float:
        return self.f / (2 - self.f)

    @property
    def same_frame(self) -> tuple:
        """What two projections must share for geographic coordinates to be the same."""
        return (self.shift, self.a, self.f) if any(self.shift) else ("wgs84",)


def parse(line: str | int) -> Projection:
    """The projection of a line or a code."""
    if isinstance(line, int) or line.strip().upper().removeprefix("EPSG:").isdigit():
        code = line if isinstance(line, int) else int(line.strip().upper().removeprefix("EPSG:"))
        if 32601 <= code <= 32660 or 32701 <= code <= 32760:
            line = f"+proj=utm +zone={code % 100} {'+south' if code > 32700 else ''} +datum=WGS84"
        elif code in CODES:
            line = CODES[code]
        else:
            raise ValueError(f"unknown projection code: {code}")
    given = dict((part.lstrip("+").split("=", 1) + [""])[:2] for part in line.split())
    kind = KINDS.get(given.get("proj", ""))
    if not kind:
        raise ValueError(f"unknown projection: {given.get('proj')}")
    number = lambda *names, default=0.0: next((float(given[k]) for k in names if k in given), default)
    if "a" in given:
        a = number("a")
        f = 1 - number("b") / a if "b" in given else 1 / number("rf") if number("rf") else 0.0
    else:
        name = given.get("ellps") or DATUMS.get(given.get("datum", "WGS84"), given.get("datum"))
        if name not in ELLIPSOIDS:
            raise ValueError(f"unknown ellipsoid: {name}")
        a, inverse = ELLIPSOIDS[name]
        f = 1 / inverse if inverse else 0.0
    if given.get("units", "m") not in UNITS:
        raise ValueError(f"unknown unit: {given['units']}")
    if given.get("pm", "greenwich") not in ("greenwich", "0"):
        raise ValueError(f"unknown prime meridian: {given['pm']}")
    unit = number("to_meter", default=UNITS[given.get("units", "m")])
    shift = tuple(float(x) for x in given["towgs84"].split(",")) if "towgs84" in given else ()
    rad = lambda *names: math.radians(number(*names))
    out = Projection(
        kind, a, f, rad("lat_0"), rad("lon_0"), rad("lat_1", "lat_0"), rad("lat_2", "lat_1", "lat_0"), number("k_0", "k", default=1.0), number("x_0"), number("y_0"), unit, (*shift, *(0.0,) * (7 - len(shift)))
    )
    if given["proj"] == "utm":
        if not 1 <= int(given.get("zone", 0)) <= 60:
            raise ValueError(f"unknown zone: {given.get('zone')}")
        out = replace(out, lat_0=0.0, lon_0=math.radians(6 * int(given["zone"]) - 183), k=0.9996, x_0=500000.0, y_0=10000000.0 if "south" in given else 0.0)
    if kind == "merc" and "lat_ts" in given:
        out = replace(out, k=math.cos(rad("lat_ts")) / math.sqrt(1 - out.e2 * math.sin(rad("lat_ts")) ** 2))
    if kind in ("lcc", "aea") and abs(out.lat_1 + out.lat_2) < 1e-10:
        raise ValueError("standard parallels that are opposite")
    return out


# series in the third flattening n; rows are the coefficients of sin 2jx or of sinh 2jx
#: From the rectifying to the transverse Mercator, and back; and from conformal to geographic latitude.
FORWARD = [
    [1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800],
    [0, 13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360],
    [0, 0, 61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440],
    [0, 0, 0, 49561 / 161280, -179 / 168, 6601661 / 7257600],
    [0, 0, 0, 0, 34729 / 80640, -3418889 / 1995840],
    [0, 0, 0, 0, 0, 212378941 / 319334400],
]
BACKWARD = [
    [1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800],
    [0, 1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720],
    [0, 0, 17 / 480, -37 / 840, -209 / 4480, 5569 / 90720],
    [0, 0, 0, 4397 / 161280, -11 / 504, -830251 / 7257600],
    [0, 0, 0, 0, 4583 / 161280, -108847 / 3991680],
    [0, 0, 0, 0, 0, 20648693 / 638668800],
]
GEOGRAPHIC = [
    [2, -2 / 3, -2, 116 / 45, 26 / 45, -2854 / 675],
    [0, 7 / 3, -8 / 5, -227 / 45, 2704 / 315, 2323 / 945],
    [0, 0, 56 / 15, -136 / 35, -1262 / 105, 73814 / 2835],
    [0, 0, 0, 4279 / 630, -332 / 35, -399572 / 14175],
    [0, 0, 0, 0, 4174 / 315, -144838 / 6237],
    [0, 0, 0, 0, 0, 601676 / 22275],
]


def series(rows: list[list[float]], n: float) -> list[float]:
    """Coefficients for one ellipsoid."""
    return [sum(c * n ** (i + 1) for i, c in enumerate(row)) for row in rows]


def rectifying_radius(p: Projection) -> float:
    n2 = p.n * p.n
    return p.a / (1 + p.n) * (1 + n2 / 4 + n2**2 / 64 + n2**3 / 256)


def _total(parts: list[Column]) -> Column:
    out = parts[0]
    for x in parts[1:]:
        out = out + x
    return out


def _sines(coefficients: list[float], x: Column) -> Column:
    return _total([F.lit(c) * F.sin(2.0 * j * x) for j, c in enumerate(coefficients, 1)])


class Steps:
    """A frame to which columns are added one step after the other, under names of its own."""

    def __init__(self, df: DataFrame) -> None:
        self.df, self.n = df, 0

    def __call__(self, *columns: Column) -> list[Column]:
        names = [f"__p{self.n + i}" for i in range(len(columns))]
        self.n += len(columns)
        self.df = self.df.withColumns(dict(zip(names, columns, strict=True)))
        return [F.col(n) for n in names]


def conformal(e: float, lat: Column) -> Column:
    """Tangent of the conformal latitude."""
    sin = F.sin(lat)
    sigma = F.sinh(e * F.atanh(e * sin)) if e else F.lit(0.0)
    tan = sin / F.cos(lat)
    return tan * F.sqrt(1.0 + sigma * sigma) - sigma * F.sqrt(1.0 + tan * tan)


def _number_conformal(e: float, lat: float) -> float:
    sigma, tan = math.sinh(e * math.atanh(e * math.sin(lat))), math.tan(lat)
    return tan * math.sqrt(1 + sigma * sigma) - sigma * math.sqrt(1 + tan * tan)


def _isometric(e: float, lat: float) -> float:
    return math.asinh(_number_conformal(e, lat))


def _wrapped(angle: Column) -> Column:
    """Within half a turn of 0."""
    return angle - 2 * math.pi * F.floor((angle + math.pi) / (2 * math.pi))


def _tmerc_origin(p: Projection) -> float:
    """Length along the meridian from the equator to the origin's latitude, by the series at the meridian."""
    chi = math.atan(_number_conformal(p.e, p.lat_0))
    return chi + sum(c * math.sin(2 * j * chi) for j, c in enumerate(series(FORWARD, p.n), 1))


def _conic(p: Projection) -> tuple[float, float, float]:
    """Cone constant, scale and the origin's radius, in semi-major axes."""
    m = lambda lat: math.cos(lat) / math.sqrt(1 - p.e2 * math.sin(lat) ** 2)
    same = abs(p.lat_1 - p.lat_2) < 1e-12
    if p.kind == "lcc":
        psi = lambda lat: _isometric(p.e, lat)
        n = math.sin(p.lat_1) if same else math.log(m(p.lat_1) / m(p.lat_2)) / (psi(p.lat_2) - psi(p.lat_1))
        f = m(p.lat_1) * math.exp(n * psi(p.lat_1)) / n
        return n, f * p.k, f * p.k * math.exp(-n * psi(p.lat_0))
    n = math.sin(p.lat_1) if same else (m(p.lat_1) ** 2 - m(p.lat_2) ** 2) / (_authalic(p, p.lat_2) - _authalic(p, p.lat_1))
    c = m(p.lat_1) ** 2 + n * _authalic(p, p.lat_1)
    return n, c, math.sqrt(c - n * _authalic(p, p.lat_0)) / n


def _authalic(p: Projection, lat: float) -> float:
    s = math.sin(lat)
    return (1 - p.e2) * (s / (1 - p.e2 * s * s) + math.atanh(p.e * s) / p.e) if p.e else 2 * s


def _forward(s: Steps, p: Projection, lon: Column, lat: Column) -> list[Column]:
    """x and y of geographic coordinates in radians."""
    if p.kind == "longlat":
        return [F.degrees(lon), F.degrees(lat)]
    (turn,) = s(_wrapped(lon - p.lon_0))
    if p.kind == "merc":
        x, y = s(p.a * p.k * turn, p.a * p.k * F.asinh(conformal(p.e, lat)))
    elif p.kind == "tmerc":
        (tau,) = s(conformal(p.e, lat))
        (cos,) = s(F.cos(turn))
        xi, eta = s(F.atan2(tau, cos), F.asinh(F.sin(turn) / F.sqrt(tau * tau + cos * cos)))
        c = series(FORWARD, p.n)
        north = xi + _total([F.lit(a) * F.sin(2.0 * j * xi) * F.cosh(2.0 * j * eta) for j, a in enumerate(c, 1)])
        east = eta + _total([F.lit(a) * F.cos(2.0 * j * xi) * F.sinh(2.0 * j * eta) for j, a in enumerate(c, 1)])
        scale = p.k * rectifying_radius(p)
        # more than a quarter of a turn away is the far side of the globe
        x, y = s(F.when(F.abs(turn) < math.pi / 2, scale * east), F.when(F.abs(turn) < math.pi / 2, scale * (north - _tmerc_origin(p))))
    else:
        n, c, origin = _conic(p)
        if p.kind == "lcc":
            radius = c * F.exp(-n * F.asinh(conformal(p.e, lat)))
        else:
            sin = F.sin(lat)
            q = (1 - p.e2) * (sin / (1 - p.e2 * sin * sin) + F.atanh(p.e * sin) / p.e) if p.e else 2.0 * sin
            radius = F.sqrt(c - n * q) / n
        (rho,) = s(radius)
        x, y = s(p.a * rho * F.sin(n * turn), p.a * (origin - rho * F.cos(n * turn)))
    return [(x + p.x_0) / p.unit, (y + p.y_0) / p.unit]


def _latitude(s: Steps, p: Projection, chi: Column) -> Column:
    """Geographic from conformal latitude."""
    (chi,) = s(chi)
    return chi + _sines(series(GEOGRAPHIC, p.n), chi)


def _backward(s: Steps, p: Projection, x: Column, y: Column) -> list[Column]:
    """Geographic coordinates, in radians, of x and y."""
    if p.kind == "longlat":
        return [F.radians(x), F.when(F.abs(y) <= 90, F.radians(y))]
    x, y = s((x * p.unit - p.x_0) / p.a, (y * p.unit - p.y_0) / p.a)
    if p.kind == "merc":
        return [_wrapped(x / p.k + p.lon_0), _latitude(s, p, F.atan(F.sinh(y / p.k)))]
    if p.kind == "tmerc":
        scale = p.k * rectifying_radius(p) / p.a
        xi, eta = s(y / scale + _tmerc_origin(p), x / scale)
        c = series(BACKWARD, p.n)
        north, east = s(
            xi - _total([F.lit(b) * F.sin(2.0 * j * xi) * F.cosh(2.0 * j * eta) for j, b in enumerate(c, 1)]),
            eta - _total([F.lit(b) * F.cos(2.0 * j * xi) * F.sinh(2.0 * j * eta) for j, b in enumerate(c, 1)]),
        )
        sinh, cos = s(F.sinh(east), F.cos(north))
        chi = F.atan2(F.sin(north), F.sqrt(sinh * sinh + cos * cos))
        return [_wrapped(F.atan2(sinh, cos) + p.lon_0), _latitude(s, p, chi)]
    n, c, origin = _conic(p)
    sign = math.copysign(1.0, n)
    down = origin - y
    rho, turn = s(sign * F.sqrt(x * x + down * down), F.atan2(sign * x, sign * down) / n)
    if p.kind == "lcc":
        lat = _latitude(s, p, F.atan(F.sinh(-F.log(rho / c) / n)))
    else:
        (q,) = s((c - n * n * rho * rho) / n)
        top = _authalic(p, math.pi / 2)
        (lat,) = s(F.when(F.abs(q) <= top * (1 + 1e-12), F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q / top)))))
        for _ in range(4 if p.e else 0):
            sin, cos = F.sin(lat), F.cos(lat)
            w = 1 - p.e2 * sin * sin
            step = w * w / (2 * cos) * (q / (1 - p.e2) - sin / w - F.atanh(p.e * sin) / p.e)
            (lat,) = s(F.when(F.abs(cos) > 1e-12, lat + step).otherwise(lat))
    return [_wrapped(turn + p.lon_0), lat]


def helmert(shift: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Matrix and offset from a datum's geocentric coordinates to those of WGS84, by position-vector rotations."""
    rx, ry, rz = (r * ARC_SECOND for r in shift[3:6])
    return (1 + shift[6] * 1e-6) * np.array([[1, -rz, ry], [rz, 1, -rx], [-ry, rx, 1]]), np.array(shift[:3])


def _shifted(s: Steps, a: Projection, b: Projection, lon: Column, lat: Column) -> list[Column]:
    """Geographic coordinates of one datum in another, on the ellipsoid's surface."""
    (sin,) = s(F.sin(lat))
    (radius,) = s(a.a / F.sqrt(1 - a.e2 * sin * sin))
    cos = F.cos(lat)
    at = s(radius * cos * F.cos(lon), radius * cos * F.sin(lon), radius * (1 - a.e2) * sin)
    m, d = helmert(a.shift)
    back, off = helmert(b.shift)
    inverse = np.linalg.inv(back)
    turn, move = inverse @ m, inverse @ (d - off)
    x, y, z = s(*[_total([F.lit(float(turn[i, k])) * at[k] for k in range(3)]) + float(move[i]) for i in range(3)])
    (r,) = s(F.sqrt(x * x + y * y))
    minor, e2 = b.a * (1 - b.f), b.e2
    (lat,) = s(F.atan2(z, r * (1 - e2)))
    for _ in range(3):  # by the parametric latitude; one step is enough near the ground
        (t,) = s(F.atan2((1 - b.f) * F.sin(lat), F.cos(lat)))
        (lat,) = s(F.atan2(z + e2 / (1 - e2) * minor * F.pow(F.sin(t), F.lit(3.0)), r - e2 * b.a * F.pow(F.cos(t), F.lit(3.0))))
    return [F.atan2(y, x), lat]


def same(source: str | int | None, target: str | int | None) -> bool:
    """Whether nothing has to be done: one of them is not known, or both are the same projection."""
    return source is None or target is None or parse(source) == parse(target)


def reproject(df: DataFrame, pairs: list[tuple[str, str]], source: str | int | None, target: str | int | None) -> DataFrame:
    """df with its pairs of columns (x, y) taken from one projection to another; as they are where one is not known.

    Longitudes and latitudes are in degrees. Columns keep their names and places.
    """
    if same(source, target):
        return df
    a, b = parse(source), parse(target)
    names = df.columns
    s = Steps(df.toDF(*[f"__c{i}" for i in range(len(names))]))
    done: dict[str, Column] = {}
    for x, y in pairs:
        lon, lat = s(*_backward(s, a, *[F.col(f"__c{names.index(k)}").cast("double") for k in (x, y)]))
        if a.same_frame != b.same_frame:
            lon, lat = s(*_shifted(s, a, b, lon, lat))
        done[x], done[y] = s(*_forward(s, b, lon, lat))
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    return s.df.select(*[finite(done[n]).alias(n) if n in done else F.col(f"__c{i}").alias(n) for i, n in enumerate(names)])
