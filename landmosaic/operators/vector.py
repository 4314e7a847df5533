"""Polygons as nested arrays: attributes, contact, distance and overlap.

A geometry is parts -> rings -> points ``struct<x, y>``; the first ring of a
part is its outline, the others are holes; a ring need not repeat its first
point.  Attributes are higher-order functions on the row.  Pairs of polygons
meet through squares of the size of their boxes, their sides in slabs of x.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landmosaic.operators.adjacency import bbox_join
from landmosaic.operators.edits import numbered
from landmosaic.storage import materialize

#: Overlaps below this share of the smaller polygon are rounding.
EPS = 1e-9
#: Lengths below the first, and below the second as a share of the coordinates, are rounding.
CLOSE, CLOSE_SHARE = 1e-9, 1e-12
#: Sides of two polygons in one slab of x, about.
SLAB_SIDES = 16
#: A polygon of more sides meets the boxes of its partners side by side.
MANY_SIDES = 256


def steps(ring: Column) -> Column:
    """``x1, y1, x2, y2`` of a ring's sides, closed."""
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(ring, after, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def ring_area(ring: Column) -> Column:
    """Signed, counter-clockwise positive."""
    return F.aggregate(steps(ring), F.lit(0.0), lambda s, e: s + (e["x1"] * e["y2"] - e["x2"] * e["y1"]) / 2)


def ring_length(ring: Column) -> Column:
    return F.aggregate(steps(ring), F.lit(0.0), lambda s, e: s + F.sqrt((e["x2"] - e["x1"]) ** 2 + (e["y2"] - e["y1"]) ** 2))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def part_area(part: Column) -> Column:
    holes = F.slice(part, 2, F.greatest(F.size(part) - 1, F.lit(0)))
    return F.abs(ring_area(part[0])) - total(F.transform(holes, lambda r: F.abs(ring_area(r))))


def vector_patches(polygons: DataFrame, rename: dict[str, str] | None = None, id_col: str | None = None, rows: tuple[int, int] | None = None) -> DataFrame:
    """Patch table of a polygon table: attributes and bounds beside the columns it came with.

    ``class_label`` and ``geometry`` must be there after renaming; ids are those
    given, else positions in the order of class, bounds and geometry.  ``rows``
    keeps the ids of a half-open range.
    """
    df = polygons.withColumnsRenamed(rename or {})
    if missing := {"class_label", "geometry"} - set(df.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    points = F.flatten(F.flatten(F.col("geometry")))
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    # an empty or missing geometry has area and length 0, and no place
    df = df.withColumns({"area": F.coalesce(total(F.transform("geometry", part_area)), F.lit(0.0)), "perimeter": F.coalesce(total(F.transform(F.flatten(F.col("geometry")), ring_length)), F.lit(0.0)), "xmin": F.array_min(xs), "ymin": F.array_min(ys), "xmax": F.array_max(xs), "ymax": F.array_max(ys)})
    if id_col:
        df = df.withColumn("patch_id", F.col(id_col).cast("long"))
    elif "patch_id" not in df.columns:
        order = ["class_label", "xmin", "ymin", "xmax", "ymax", F.xxhash64(F.col("geometry").cast("string"))]
        df = numbered(df, [], order, "patch_id").withColumn("patch_id", F.col("patch_id").cast("long"))
    df = df.where((F.col("patch_id") >= rows[0]) & (F.col("patch_id") < rows[1])) if rows else df
    return with_rep_point(df)


def with_rep_point(df: DataFrame) -> DataFrame:
    """Adds ``rep_x, rep_y``: the middle of the widest inner span of the line at mid height."""
    y = (F.col("ymin") + F.col("ymax")) / 2
    sides = F.flatten(F.transform(F.flatten(F.col("geometry")), steps))
    crossing = F.filter(sides, lambda e: (e["y1"] > y) != (e["y2"] > y))
    xs = F.array_sort(F.transform(crossing, lambda e: e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"])))
    spans = F.transform(F.sequence(F.lit(1), F.greatest(F.size(xs) - 1, F.lit(1)), F.lit(2)), lambda i: F.struct((F.get(xs, i) - F.get(xs, i - 1)).alias("w"), ((F.get(xs, i) + F.get(xs, i - 1)) / 2).alias("x")))
    return df.withColumn("rep_x", F.coalesce(F.array_max(spans)["x"], (F.col("xmin") + F.col("xmax")) / 2)).withColumn("rep_y", y)


def segments(polygons: DataFrame, id_col: str = "patch_id") -> DataFrame:
    """``id, part, ring, seq, x1, y1, x2, y2``, outlines turned clockwise and holes the other way."""
    rings = polygons.select(F.col(id_col).alias("id"), F.posexplode("geometry").alias("part", "rings"))
    rings = rings.select("id", "part", F.posexplode("rings").alias("ring", "points"))
    outward = (ring_area(F.col("points")) > 0) == (F.col("ring") == 0)
    turned = F.when(outward, F.reverse("points")).otherwise(F.col("points"))
    return rings.select("id", "part", "ring", F.posexplode(steps(turned)).alias("seq", "e")).select("id", "part", "ring", "seq", "e.*")


def boxes(patches: DataFrame) -> DataFrame:
    return patches.select(F.col("patch_id").alias("id"), "xmin", "ymin", "xmax", "ymax")


def with_boxes(pairs: DataFrame, one: DataFrame, other: DataFrame, tolerance: float) -> DataFrame:
    """The pairs with the boxes of both polygons, how far apart, at most, sides are of interest, and the slabs in which sides meet.

    A slab is as wide as sides are on average, as the distance of interest
    needs, and as holds ``SLAB_SIDES`` of the sides if they are spread evenly.
    """

    def placed(df: DataFrame, p: str) -> DataFrame:
        ring = F.flatten(F.transform(F.flatten(F.col("geometry")), steps))
        run = F.aggregate(ring, F.lit(0.0), lambda s, e: s + F.abs(e["x2"] - e["x1"]))
        return df.select(F.col("patch_id").alias(f"{p}_id"), *[F.col(c).alias(f"{p}_{c}") for c in ("xmin", "ymin", "xmax", "ymax")], F.size(ring).alias(f"{p}_sides"), run.alias(f"{p}_run"))

    corners = [F.abs(F.col(f"{p}_{c}")) for p in ("one", "other") for c in ("xmin", "ymin", "xmax", "ymax")]
    reach = tolerance + CLOSE + 2 * CLOSE_SHARE * F.greatest(*corners)
    rows = pairs.join(placed(one, "one"), "one_id").join(placed(other, "other"), "other_id").withColumn("reach", reach)
    low, high = F.greatest("one_xmin", "other_xmin") - F.col("reach"), F.least("one_xmax", "other_xmax") + F.col("reach")
    sides = F.col("one_sides") + F.col("other_sides")
    width = F.greatest((F.col("one_run") + F.col("other_run")) / sides, (high - low) * SLAB_SIDES / sides, 2 * F.col("reach"))
    rows = rows.withColumn("slab_low", low).withColumn("slab_width", width)
    return rows.withColumn("slabs", F.greatest(F.ceil((high - low) / width), F.lit(1)).cast("int")).drop("one_run", "other_run")


def sides_near(pairs: DataFrame, sides: DataFrame, mine: str, theirs: str, axes: str) -> DataFrame:
    """The pairs with each side of ``mine`` that reaches the box of ``theirs`` in all of the ``axes``.

    The sides of a polygon of many are dealt out by their own boxes, so an
    outline of a million sides beside as many small polygons is no problem.
    """
    place = ("part", "ring", "seq")
    side = sides.withColumnRenamed("id", f"{mine}_id")
    ends = lambda x: (F.least(f"{x}1", f"{x}2"), F.greatest(f"{x}1", f"{x}2"))
    reached = lambda x: (F.col(f"{theirs}_{x}min") - F.col("reach"), F.col(f"{theirs}_{x}max") + F.col("reach"))
    near = F.lit(True)
    for x in axes:
        near &= (ends(x)[1] >= reached(x)[0]) & (ends(x)[0] <= reached(x)[1])
    rows = pairs.where(F.col(f"{mine}_sides") <= MANY_SIDES).join(side, f"{mine}_id").where(near)
    large = pairs.where(F.col(f"{mine}_sides") > MANY_SIDES)
    if not large.isEmpty():
        box = lambda at: [c.alias(f"{x}{m}") for x in "xy" for c, m in zip(at(x) if x in axes else (F.lit(0.0), F.lit(0.0)), ("min", "max"), strict=True)]
        one = side.join(large.select(f"{mine}_id").distinct(), f"{mine}_id", "left_semi").select(f"{mine}_id", F.struct(*place).alias("id"), *box(ends))
        other = large.select(f"{mine}_id", F.col(f"{theirs}_id").alias("id"), *box(reached))
        met = bbox_join(one.withColumnRenamed(f"{mine}_id", "whose"), other.withColumnRenamed(f"{mine}_id", "whose"), "whose")
        met = met.select(F.col("whose").alias(f"{mine}_id"), F.col("other_id").alias(f"{theirs}_id"), *[F.col(f"one_id.{c}").alias(c) for c in place])
        rows = rows.unionByName(met.join(large, [f"{mine}_id", f"{theirs}_id"]).join(side, [f"{mine}_id", *place]).select(rows.columns))
    return rows


def segment_pairs(pairs: DataFrame, one: DataFrame, other: DataFrame, axes: str) -> DataFrame:
    """Sides of ``one_id`` beside sides of ``other_id`` in every ``slab`` that both reach, for candidate pairs only.

    A side that does not reach the other polygon's box in one of the ``axes`` is left out before sides meet.
    """

    def sides(df: DataFrame, p: str, mine: str, theirs: str, reach: Column) -> DataFrame:
        rows = sides_near(pairs, df, mine, theirs, axes).drop("part", "ring", "seq", "one_sides", "other_sides")
        rows = rows.withColumnsRenamed({c: f"{p}_{c}" for c in ("x1", "y1", "x2", "y2")})
        slab = lambda x: F.least(F.greatest(F.floor((x - F.col("slab_low")) / F.col("slab_width")), F.lit(0)), F.col("slabs") - 1).cast("int")
        rows = rows.withColumn(f"{p}_slab", slab(F.least(f"{p}_x1", f"{p}_x2") - reach)).withColumn("until", slab(F.greatest(f"{p}_x1", f"{p}_x2") + reach))
        return rows.withColumn("slab", F.explode(F.sequence(f"{p}_slab", "until"))).drop("until")

    a = sides(one, "a", "one", "other", F.col("reach") if "y" in axes else F.lit(0.0))
    b = sides(other, "b", "other", "one", F.lit(0.0)).select("one_id", "other_id", "slab", "b_slab", "b_x1", "b_y1", "b_x2", "b_y2")
    return a.join(b, ["one_id", "other_id", "slab"])


def overlap_areas(pairs: DataFrame, one: DataFrame, other: DataFrame) -> DataFrame:
    """``one_id, other_id, area`` of the intersections, exactly, of pairs ``with_boxes``.

    Each side stands for the signed trapezium down to a base line below both
    polygons.  Two trapezia overlap by the integral of the lower of two lines
    over their common range of x, which has a closed form; each slab gives its
    part of it.
    """
    based = pairs.withColumn("base", F.least("one_ymin", "other_ymin"))
    rows = segment_pairs(based, one.where("x1 <> x2"), other.where("x1 <> x2"), "x")
    edge = F.col("slab_low") + (F.col("slab") * F.col("slab_width"))
    low = F.greatest(F.least("a_x1", "a_x2"), F.least("b_x1", "b_x2"), F.when(F.col("slab") > 0, edge))
    high = F.least(F.greatest("a_x1", "a_x2"), F.greatest("b_x1", "b_x2"), F.when(F.col("slab") < F.col("slabs") - 1, edge + F.col("slab_width")))
    rows = rows.withColumn("low", low).withColumn("high", high).where("high > low")
    line = lambda p, x: F.col(f"{p}_y1") + (F.col(x) - F.col(f"{p}_x1")) * (F.col(f"{p}_y2") - F.col(f"{p}_y1")) / (F.col(f"{p}_x2") - F.col(f"{p}_x1")) - F.col("base")
    al, ah, bl, bh = line("a", "low"), line("a", "high"), line("b", "low"), line("b", "high")
    dl, dh, width = al - bl, ah - bh, F.col("high") - F.col("low")
    at = F.try_divide(dl, dl - dh)  # where the lines cross, as a share of the range
    cross = al + at * (ah - al)
    simple = width * (F.least(al, bl) + F.least(ah, bh)) / 2
    bent = width * (at * (F.least(al, bl) + cross) + (1 - at) * (cross + F.least(ah, bh))) / 2
    value = F.when(dl * dh < 0, bent).otherwise(simple)
    sign = F.signum(F.col("a_x2") - F.col("a_x1")) * F.signum(F.col("b_x2") - F.col("b_x1"))
    return rows.groupBy("one_id", "other_id").agg(F.sum(sign * value).alias("area"))


def _cross(ox, oy, ax, ay, bx, by) -> Column:
    return (ax - ox) * (by - oy) - (ay - oy) * (bx - ox)


def _point_gap(px, py, x1, y1, x2, y2) -> Column:
    """Squared distance of a point and a side."""
    dx, dy = x2 - x1, y2 - y1
    t = F.least(F.greatest(F.coalesce(F.try_divide((px - x1) * dx + (py - y1) * dy, dx * dx + dy * dy), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return (px - x1 - t * dx) ** 2 + (py - y1 - t * dy) ** 2


def side_relations(pairs: DataFrame, one: DataFrame, other: DataFrame) -> DataFrame:
    """``one_id, other_id, gap, shared``: distance of the outlines and length they run together.

    Pairs come ``with_boxes``; one whose outlines are further apart than that has no row or too large a gap.
    """
    rows = segment_pairs(pairs, one, other, "xy").where(F.col("slab") == F.greatest("a_slab", "b_slab"))  # once, in the first slab of both
    a, b = [[F.col(f"{p}_{c}") for c in ("x1", "y1", "x2", "y2")] for p in "ab"]
    d1, d2 = _cross(b[0], b[1], b[2], b[3], a[0], a[1]), _cross(b[0], b[1], b[2], b[3], a[2], a[3])
    d3, d4 = _cross(a[0], a[1], a[2], a[3], b[0], b[1]), _cross(a[0], a[1], a[2], a[3], b[2], b[3])
    crossing = (d1 * d2 < 0) & (d3 * d4 < 0)
    gap = F.least(_point_gap(a[0], a[1], *b), _point_gap(a[2], a[3], *b), _point_gap(b[0], b[1], *a), _point_gap(b[2], b[3], *a))
    length = F.sqrt((a[2] - a[0]) ** 2 + (a[3] - a[1]) ** 2)
    along = lambda x, y: F.try_divide((x - a[0]) * (a[2] - a[0]) + (y - a[1]) * (a[3] - a[1]), length)
    s, e = along(b[0], b[1]), along(b[2], b[3])
    common = F.greatest(F.least(F.greatest(s, e), length) - F.greatest(F.least(s, e), F.lit(0.0)), F.lit(0.0))
    close = CLOSE + CLOSE_SHARE * F.greatest(*[F.abs(c) for c in a + b])
    flat = (F.abs(d3) <= close * (length + close)) & (F.abs(d4) <= close * (length + close))
    return rows.groupBy("one_id", "other_id").agg(F.sqrt(F.min(F.when(crossing, 0.0).otherwise(gap))).alias("gap"), F.sum(F.when(flat, common).otherwise(0.0)).alias("shared"), F.max(close).alias("close"))


def relations(one: DataFrame, other: DataFrame | None = None, tolerance: float = 0.0) -> DataFrame:
    """``one_id, other_id, distance, contact`` of polygons at most ``tolerance`` apart.

    ``contact`` is ``interior`` (they overlap), ``edge`` (sides run together),
    ``corner`` (they only touch) or ``none``.  With one table every pair comes
    once, smaller id first.
    """
    if tolerance < 0:
        raise ValueError("the tolerance must not be negative")
    right = one if other is None else other
    margin = lambda c: tolerance + CLOSE + 2 * CLOSE_SHARE * F.abs(F.col(c))
    grown = boxes(one).where("xmin is not null").select("id", *[(F.col(c) + margin(c) if c.endswith("max") else F.col(c) - margin(c)).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])
    pairs = bbox_join(grown, boxes(right).where("xmin is not null"))
    pairs = pairs.where("one_id < other_id") if other is None else pairs
    pairs = materialize(with_boxes(pairs, one, right, tolerance))
    a, b, key = segments(one), segments(right), ["one_id", "other_id"]
    rows = pairs.select(*key).join(side_relations(pairs, a, b), key, "left").join(overlap_areas(pairs, a, b), key, "left")
    size = lambda df, key, name: df.select(F.col("patch_id").alias(key), F.col("area").alias(name))
    rows = rows.join(size(one, "one_id", "a1"), "one_id").join(size(right, "other_id", "a2"), "other_id")
    inside = F.coalesce("area", F.lit(0.0)) > EPS * F.least("a1", "a2")
    distance = F.when(inside, 0.0).otherwise(F.col("gap"))
    contact = F.when(inside, "interior").when(F.col("shared") > F.col("close"), "edge").when(F.col("gap") <= F.col("close"), "corner").otherwise("none")
    return rows.where(distance <= tolerance + F.coalesce("close", F.lit(0.0))).select("one_id", "other_id", distance.alias("distance"), contact.alias("contact"), F.coalesce("area", F.lit(0.0)).alias("overlap"))


def vector_edges(patches: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """``src, dst, distance`` of polygons that touch or lie within the tolerance."""
    return relations(patches, None, tolerance).select(F.col("one_id").alias("src"), F.col("other_id").alias("dst"), "distance")


def identify(old: DataFrame, new: DataFrame, mode: str = "interior") -> DataFrame:
    """``src_id, trg_id`` of polygons of one class in contact at least as close as ``mode``."""
    wanted = {"interior": ["interior"], "edge": ["interior", "edge"], "corner": ["interior", "edge", "corner"]}[mode]
    label = lambda df, key, name: df.select(F.col("patch_id").alias(key), F.col("class_label").alias(name))
    rows = relations(old, new).where(F.col("contact").isin(wanted))
    rows = rows.join(label(old, "one_id", "c1"), "one_id").join(label(new, "other_id", "c2"), "other_id").where("c1 = c2")
    return rows.select(F.col("one_id").alias("src_id"), F.col("other_id").alias("trg_id"))
