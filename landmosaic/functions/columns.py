"""Scalar and table functions of the landscape model."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Numbers of the seven dynamics.
DYNAMIC_NUMBERS = {"split": 0, "shrank": 1, "unchanged": 2, "complex": 3, "grew": 4, "merged": 5, "birth": 6}

# WGS84 and UTM.
SEMI_MAJOR, FLATTENING, SCALE, EAST, SOUTH = 6378137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0


def in_classes(classes: list) -> Column:
    return F.col("class_label").isin(list(classes))


def label_contains(text: str) -> Column:
    return F.col("class_label").contains(text)


def grouped_classes(groups: dict[str, list]) -> Column:
    """The name of the group that a class belongs to; null for none."""
    pairs = [F.lit(str(x)) for name, members in groups.items() for m in members for x in (m, name)]
    return F.try_element_at(F.create_map(*pairs), F.col("class_label"))


def classes(table: DataFrame) -> DataFrame:
    return table.select("class_label").distinct().orderBy("class_label")


def with_legend(table: DataFrame, legend: DataFrame) -> DataFrame:
    """Adds the ``label`` of each class; legends are short, and Spark broadcasts them by their size."""
    return table.join(legend, "class_label", "left")


def match_relate(relation: Column, pattern: str) -> Column:
    """Whether a nine-character relation fits a pattern: ``*`` is anything, ``T`` a dimension."""
    if len(pattern) != 9 or set(pattern) - set("*TF012"):
        raise ValueError("a pattern has nine of the characters *, T, F, 0, 1, 2")
    return relation.rlike("^" + pattern.replace("*", ".").replace("T", "[012]") + "$")


def dynamic_number(dynamic: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in DYNAMIC_NUMBERS.items() for x in pair])[dynamic]


def category_codes(table: DataFrame, column: str) -> DataFrame:
    """Adds ``code``: numbers stay as they are, text becomes its place among the distinct values."""
    if dict(table.dtypes)[column] != "string":
        return table.withColumn("code", F.col(column))
    codes = table.select(column).where(F.col(column).isNotNull()).distinct().withColumn("code", F.dense_rank().over(Window.orderBy(column)) - 1)
    return table.join(codes, column, "left")


def hectares(square_metres: Column) -> Column:
    return square_metres / 10_000


def kilometres(metres: Column) -> Column:
    return metres / 1000


def _series() -> tuple[float, list[float], list[float], float]:
    n = FLATTENING / (2 - FLATTENING)
    radius = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    back = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    return radius, forward, back, math.sqrt(FLATTENING * (2 - FLATTENING))


def _sinh(x: Column) -> Column:
    return F.sinh(x)


def to_utm(lon: Column, lat: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Easting and northing of WGS84 degrees, by the series for the transverse Mercator projection."""
    radius, forward, _, e = _series()
    phi, lam = F.radians(lat), F.radians(lon) - math.radians(6 * zone - 183)
    s = F.sin(phi)
    t = _sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(forward, 1):
        x = x + a * F.cos(2 * j * xi) * _sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return EAST + SCALE * radius * x, SCALE * radius * y + (SOUTH if south else 0.0)


def from_utm(x: Column, y: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """WGS84 longitude and latitude in degrees."""
    radius, _, back, e = _series()
    xi, eta = (y - (SOUTH if south else 0.0)) / (SCALE * radius), (x - EAST) / (SCALE * radius)
    u, v = xi, eta
    for j, b in enumerate(back, 1):
        u = u - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        v = v - b * F.cos(2 * j * xi) * _sinh(2 * j * eta)
    chi = F.asin(F.sin(u) / F.cosh(v))
    psi, phi = F.atanh(F.sin(chi)), chi
    for _ in range(5):  # isometric to geographic latitude
        phi = F.asin(F.tanh(psi + e * F.atanh(e * F.sin(phi))))
    return F.degrees(F.atan2(_sinh(v), F.cos(u))) + (6 * zone - 183), F.degrees(phi)


def _zone(code: str) -> tuple[int, bool] | None:
    number = int(code.removeprefix("EPSG:"))
    if number == 4326:
        return None
    if number // 100 not in (326, 327) or not 1 <= number % 100 <= 60:
        raise ValueError(f"{code} is neither WGS84 nor a UTM zone")
    return number % 100, number // 100 == 327


def reproject_geometry(polygons: DataFrame, source: str, target: str, geometry: str = "geometry") -> DataFrame:
    """The same polygons with every point in the target CRS."""
    a, b = _zone(source), _zone(target)

    def moved(p: Column) -> Column:
        lon, lat = from_utm(p["x"], p["y"], *a) if a else (p["x"], p["y"])
        x, y = to_utm(lon, lat, *b) if b else (lon, lat)
        return F.struct(x.alias("x"), y.alias("y"))

    if a == b:
        return polygons
    return polygons.withColumn(geometry, F.transform(geometry, lambda part: F.transform(part, lambda ring: F.transform(ring, moved))))


def reproject_points(table: DataFrame, source: str, target: str, x: str = "x", y: str = "y") -> DataFrame:
    """Coordinates between EPSG:4326 and UTM zones EPSG:326zz and EPSG:327zz."""
    a, b = _zone(source), _zone(target)
    if a == b:
        return table
    lon, lat = from_utm(F.col(x), F.col(y), *a) if a else (F.col(x), F.col(y))
    out = table.withColumns({x: lon, y: lat})
    if b:
        east, north = to_utm(F.col(x), F.col(y), *b)
        out = out.withColumns({x: east, y: north})
    return out
