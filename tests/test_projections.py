"""Projections against published examples, and round trips."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridlode.functions import projections as P

BRITISH = "+proj=tmerc +lat_0=49 +lon_0=-2 +k=0.9996012717 +x_0=400000 +y_0=-100000 +ellps=airy +units=m"
GAUSS = "+proj=tmerc +lon_0=105 +lat_0=0 +x_0=500000 +y_0=0 +k_0=1 +towgs84=23.57,-140.95,-79.8,0,0.35,0.79,-0.22 +ellps=krass +units=m +lon_wrap=45 +no_defs"
JAMAICA = "+proj=lcc +lat_1=18 +lat_0=18 +lon_0=-77 +k_0=1 +x_0=250000 +y_0=150000 +ellps=clrk66"
TEXAS = "+proj=lcc +lat_1=28.3833333333333333 +lat_2=30.2833333333333333 +lat_0=27.8333333333333333 +lon_0=-99 +x_0=609601.21920243840 +y_0=0 +ellps=clrk66 +units=us-ft"
ALBERS = "+proj=aea +lat_1=29.5 +lat_2=45.5 +lat_0=23 +lon_0=-96 +ellps=clrk66"


def one(spark, x, y, source, target):
    r = P.reproject(spark.createDataFrame([(float(x), float(y))], "x double, y double"), [("x", "y")], source, target).first()
    return r.x, r.y


def plain(ellipsoid):
    return f"+proj=longlat +ellps={ellipsoid}"


def dms(d, m, s):
    return math.copysign(abs(d) + m / 60 + s / 3600, d)


#: Worked examples of published guides: line, ellipsoid, longitude, latitude, easting, northing, tolerance.
EXAMPLES = [
    (BRITISH, "airy", 0.5, 50.5, 577274.99, 69740.50, 0.02),
    (JAMAICA, "clrk66", dms(-76, 56, 37.26), dms(17, 55, 55.80), 255966.58, 142493.51, 0.02),
    (TEXAS, "clrk66", -96.0, 28.5, 2963503.91, 254759.80, 0.05),
    (ALBERS, "clrk66", -75.0, 35.0, 1885472.7, 1535925.0, 0.1),
]


@pytest.mark.parametrize("line,ellipsoid,lon,lat,x,y,within", EXAMPLES)
def test_published_examples(spark, line, ellipsoid, lon, lat, x, y, within):
    got = one(spark, lon, lat, plain(ellipsoid), line)
    assert got == pytest.approx((x, y), abs=within)
    assert one(spark, *got, line, plain(ellipsoid)) == pytest.approx((lon, lat), abs=1e-10)


def test_utm_and_web_mercator(spark):
    assert one(spark, 3, 0, 4326, 32631) == pytest.approx((500000, 0), abs=1e-6)
    assert one(spark, 3, 0, "EPSG:4326", "EPSG:32731") == pytest.approx((500000, 10000000), abs=1e-6)
    assert one(spark, 180 / math.pi, 0, 4326, 3857)[0] == pytest.approx(6378137, abs=1e-6)
    # the meridian's quarter of WGS84
    assert one(spark, 3, 90, 4326, "+proj=tmerc +lon_0=3 +datum=WGS84")[1] == pytest.approx(10001965.7293, abs=1e-3)


def test_position_vector_shift():
    m, d = P.helmert((0, 0, 4.5, 0, 0, 0.554, 0.219))
    assert (m @ [3657660.66, 255768.55, 5201382.11] + d) == pytest.approx([3657660.78, 255778.43, 5201387.75], abs=0.01)


LINES = [GAUSS, BRITISH, TEXAS, ALBERS, "EPSG:32648", "EPSG:3857", "EPSG:5070", "EPSG:3347", "+proj=merc +lat_ts=40 +lon_0=10 +ellps=bessel", "+proj=aea +lat_1=-10 +lat_2=-40 +lon_0=25 +ellps=WGS84", "+proj=lcc +lat_1=-20 +lat_2=-35 +lat_0=-25 +lon_0=25 +ellps=intl +units=km", "+proj=tmerc +lon_0=20 +a=6371000 +b=6371000", "+proj=aea +lat_1=30 +lat_2=50 +ellps=sphere"]


@pytest.mark.parametrize("line", LINES)
def test_round_trip_below_a_millimetre(spark, line):
    p, rng = P.parse(line), random.Random(4)
    lon0, lat0 = math.degrees(p.lon_0), math.degrees(p.lat_1 or p.lat_0)
    rows = [(i, lon0 + rng.uniform(-12, 12), max(-84.0, min(84.0, lat0 + rng.uniform(-30, 30)))) for i in range(300)]
    own = f"+proj=longlat +a={p.a!r} +b={p.a * (1 - p.f)!r}" + (f" +towgs84={','.join(map(str, p.shift))}" if any(p.shift) else "")
    frame = spark.createDataFrame(rows, "k int, x double, y double")
    there = P.reproject(frame, [("x", "y")], own, line)
    back = {r.k: (r.x, r.y) for r in P.reproject(there, [("x", "y")], line, own).collect()}
    for k, lon, lat in rows:
        x, y = back[k]
        turn = (x - lon + 180) % 360 - 180
        assert math.hypot(turn * math.cos(math.radians(lat)), y - lat) * 111320 < 1e-3, (line, lon, lat)


def test_between_datums(spark):
    """The shift moves places by its offset, and back again to the height that is left out."""
    x, y = one(spark, 105.0, 71.0, 4326, GAUSS)
    assert abs(x - 500000) < 300 and x != 500000
    assert one(spark, x, y, GAUSS, 4326) == pytest.approx((105.0, 71.0), abs=2e-8)
    assert one(spark, 10, 50, "EPSG:4269", "EPSG:4326") == pytest.approx((10, 50), abs=1e-12)


def test_unknown_and_missing(spark):
    for line in ("+proj=stere +lat_0=90", "+proj=tmerc +ellps=none", "+proj=utm +zone=61", 9999, "+proj=lcc +lat_1=20 +lat_2=-20", "+proj=tmerc +units=parsec", "lon and lat"):
        with pytest.raises(ValueError):
            P.parse(line)
    frame = spark.createDataFrame([(None, 1.0, "a"), (float("nan"), 2.0, "b"), (200.0, 91.0, "c")], "x double, y double, __p0 string")
    assert P.reproject(frame, [("x", "y")], None, GAUSS).collect() is not None and P.reproject(frame, [("x", "y")], GAUSS, None) is frame
    got = P.reproject(frame, [("x", "y")], 4326, 32631)
    assert got.columns == frame.columns and [r["__p0"] for r in got.collect()] == ["a", "b", "c"]
    assert got.where(F.col("x").isNotNull()).count() == 0


def test_two_pairs_keep_their_places(spark):
    frame = spark.createDataFrame([(1, 3.0, 0.0, 3.0, 1.0, "s")], "k int, x1 double, y1 double, x2 double, y2 double, name string")
    r = P.reproject(frame, [("x1", "y1"), ("x2", "y2")], 4326, 32631).first()
    assert (r.k, r.name, r.x1, r.x2) == (1, "s", pytest.approx(500000), pytest.approx(500000)) and r.y2 > r.y1 == pytest.approx(0, abs=1e-6)
