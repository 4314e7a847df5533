"""Landscape, class, component and patch metrics as aggregates.

Every level is one grouped aggregate over the patch table; ratios that are
undefined are null.  ``metrics_long`` gives the long table of named values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landmosaic.storage import dealt


@dataclass(frozen=True)
class Metric:
    """One value with its name and unit; metrics compare by value."""

    value: float | None
    name: str
    description: str = ""
    variant: str = "conventional"
    unit: str = ""

    def _other(self, other):
        return other.value if isinstance(other, Metric) and None not in (self.value, other.value) else None

    def __eq__(self, other):
        return self._other(other) is not None and self.value == other.value

    def __lt__(self, other):
        return self._other(other) is not None and self.value < other.value

    def __le__(self, other):
        return self._other(other) is not None and self.value <= other.value

    def __gt__(self, other):
        return self._other(other) is not None and self.value > other.value

    def __ge__(self, other):
        return self._other(other) is not None and self.value >= other.value

    __hash__ = object.__hash__


#: name -> (unit, description) by level.
UNITS: dict[str, dict[str, tuple[str, str]]] = {
    "landscape": {
        "num_patches": ("", "number of patches"), "avg_patch_area": ("CRS.unit**2", "mean patch area"), "total_area": ("CRS.unit**2", "area of all patches"),
        "patch_density": ("1/CRS.unit**2", "patches per area"), "largest_patch_index": ("", "share of the largest patch"),
        "shannon_diversity_index": ("", "Shannon entropy of class shares"), "simpson_diversity_index": ("", "one less the sum of squared class shares"),
    },
    "class": {
        "num_patches": ("", "patches of the class"), "avg_patch_area": ("CRS.unit**2", "mean patch area"), "total_area": ("CRS.unit**2", "area of the class"),
        "proportion_of_landscape": ("", "class area over landscape area"), "patch_density": ("1/CRS.unit**2", "patches over landscape area"),
        "largest_patch_index": ("", "largest patch over landscape area"), "total_edge": ("CRS.unit", "sum of perimeters"),
        "edge_density": ("1/CRS.unit", "total edge over class area"), "shape_index": ("", "quarter total edge over root of class area"),
        "effective_mesh_size": ("CRS.unit**2", "sum of squared patch areas over landscape area"),
    },
    "component": {
        "num_components": ("", "connected components"), "avg_component_area": ("CRS.unit**2", "mean area of components"),
        "avg_component_isolation": ("CRS.unit", "mean of the distinct distances between components"),
    },
}
EXTRA: dict[tuple[str, str], Callable[[], Column]] = {}


def register_metric(name: str, level: str, column: Callable[[], Column], unit: str = "", description: str = "") -> None:
    """Add an aggregate over the patch table to ``landscape_metrics`` or ``class_metrics``."""
    if level not in ("landscape", "class"):
        raise ValueError("own metrics are of level landscape or class")
    UNITS[level][name] = (unit, description)
    EXTRA[level, name] = column


def forget_metric(name: str, level: str) -> None:
    """Undo ``register_metric``."""
    UNITS[level].pop(name, None)
    EXTRA.pop((level, name), None)


def extras(level: str) -> list[Column]:
    return [column().alias(name) for (at, name), column in EXTRA.items() if at == level]


def landscape_metrics(patches: DataFrame) -> DataFrame:
    """One row for each ``t``."""
    a = F.col("area")
    basic = patches.groupBy("t").agg(F.count("*").alias("num_patches"), F.avg(a).alias("avg_patch_area"), F.sum(a).alias("total_area"), F.try_divide(F.lit(1.0), F.avg(a)).alias("patch_density"), F.try_divide(F.max(a), F.sum(a)).alias("largest_patch_index"), *extras("landscape"))
    share = F.try_divide(F.col("c"), F.sum("c").over(Window.partitionBy("t")))
    by_class = patches.groupBy("t", "class_label").agg(F.sum(a).alias("c")).select("t", share.alias("p"))
    shares = by_class.groupBy("t").agg((-F.sum(F.col("p") * F.ln("p"))).alias("shannon_diversity_index"), (1 - F.sum(F.col("p") ** 2)).alias("simpson_diversity_index"))
    return basic.join(shares, "t")


def class_metrics(patches: DataFrame, classes: list | None = None) -> DataFrame:
    """One row for each ``t`` and class; shares are of the whole slice whatever classes are asked for."""
    a, p = F.col("area"), F.col("perimeter")
    sums = patches.groupBy("t", "class_label").agg(F.count("*").alias("num_patches"), F.avg(a).alias("avg_patch_area"), F.sum(a).alias("total_area"), F.max(a).alias("_max"), F.sum(p).alias("total_edge"), F.sum(a * a).alias("_squares"), *extras("class"))
    whole = F.sum("total_area").over(Window.partitionBy("t"))
    out = sums.withColumn("_whole", whole).select(
        "t", "class_label", "num_patches", "avg_patch_area", "total_area", F.try_divide(F.col("total_area"), F.col("_whole")).alias("proportion_of_landscape"),
        F.try_divide(F.col("num_patches"), F.col("_whole")).alias("patch_density"), F.try_divide(F.col("_max"), F.col("_whole")).alias("largest_patch_index"), "total_edge",
        F.try_divide(F.col("total_edge"), F.col("total_area")).alias("edge_density"), F.try_divide(0.25 * F.col("total_edge"), F.sqrt("total_area")).alias("shape_index"),
        F.try_divide(F.col("_squares"), F.col("_whole")).alias("effective_mesh_size"), *[n for at, n in EXTRA if at == "class"],
    )
    if classes is None:
        return out
    # every class asked for at every time, those that are absent with counts and sums of 0; the list is the caller's
    slots = patches.select("t").distinct().withColumn("class_label", F.explode(F.array(*[F.lit(str(c)) for c in dict.fromkeys(classes)]).cast("array<string>")))
    return slots.join(out, ["t", "class_label"], "left").fillna(0, ["num_patches", "total_area", "total_edge"])


def class_timeseries(patches: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Every class at every time: counts and sums are 0 where a class is absent, ratios null."""
    times, classes = patches.select("t").distinct(), patches.select("class_label").distinct()
    # the frame has times x classes rows by definition; both are short lists of distinct values
    slots = times.withColumn("one", F.lit(1)).join(classes.withColumn("one", F.lit(1)), "one").drop("one")
    out = slots.join(class_metrics(patches), ["t", "class_label"], "left").fillna(0, ["num_patches", "total_area", "total_edge"])
    return out.select("t", "class_label", *(names or UNITS["class"]))


def component_metrics(components: DataFrame, patches: DataFrame, distances: DataFrame | None = None) -> DataFrame:
    """One row for each ``t``: number and mean area of components, and their isolation if distances are given.

    ``components`` is (t, component_id, patch_id); ``distances`` (t, distance)
    between components, once or more often.  Isolation is the mean of the
    *distinct* distances as single floats: 0 for one component, null for two.
    """
    sizes = dealt(components).join(patches.select("t", "patch_id", "area"), ["t", "patch_id"]).groupBy("t", "component_id").agg(F.sum("area").alias("area"))
    out = sizes.groupBy("t").agg(F.count("*").alias("num_components"), F.avg("area").alias("avg_component_area"))
    if distances is None:
        return out
    mean = distances.select("t", F.col("distance").alias("d")).distinct().groupBy("t").agg(F.avg(F.col("d").cast("float").cast("double")).alias("mean"))
    out = out.join(mean, "t", "left")
    isolation = F.when(F.col("num_components") == 1, 0.0).when(F.col("num_components") > 2, F.col("mean"))
    return out.withColumn("avg_component_isolation", isolation).drop("mean")


def mean_nearest_component_distance(distances: DataFrame) -> DataFrame:
    """The mean over components of the distance to the nearest other one."""
    both = distances.select("t", "src", "distance").unionByName(distances.select("t", F.col("dst").alias("src"), "distance"))
    return both.groupBy("t", "src").agg(F.min("distance").alias("d")).groupBy("t").agg(F.avg("d").alias("mean_nearest_component_distance"))


def patch_aggregates(patches: DataFrame, how: str | Callable[[str], Column] = "mean") -> DataFrame:
    """Per time and class, an aggregate of the patch metrics: a name or a function from column name to Column."""
    named = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum, "median": F.median, "var": F.var_samp, "count": F.count}
    if isinstance(how, str) and how not in named:
        raise ValueError(f"unknown aggregator {how}")
    f = named[how] if isinstance(how, str) else how
    names = ("area", "perimeter", "perimeter_area_ratio", "shape_index", "fractal_dimension")
    return patches.groupBy("t", "class_label").agg(*[f(n).alias(n) for n in names])


def of_series(f: Callable) -> Callable[[str], Column]:
    """An aggregator for ``patch_aggregates`` from a function of a pandas Series to a number; each group is one task's."""
    import pandas as pd

    def aggregate(values):
        return float(f(values))

    aggregate.__annotations__ = {"values": pd.Series, "return": float}  # what marks it as an aggregate
    udf = F.pandas_udf(aggregate, "double")
    return lambda name: udf(F.col(name))


@dataclass(frozen=True)
class Mergeable:
    """An aggregate of one's own in parts: a batch's values to a state, states (rows) to one, the last to a number.

    A state is a list of as many numbers whatever it stands for, so a class of
    any size costs a task one state.
    """

    part: Callable[[np.ndarray], Sequence[float]]
    merge: Callable[[np.ndarray], Sequence[float]]
    finish: Callable[[Sequence[float]], float]


def mergeable_aggregates(patches: DataFrame, how: Mergeable, names: Sequence[str] = ("area", "perimeter"), by: Sequence[str] = ("t", "class_label")) -> DataFrame:
    """``by`` and, for each name, what ``how`` makes of its values; nulls are left out, no values give null."""
    kinds = dict(patches.dtypes)
    keys = ", ".join(f"{c} {kinds[c]}" for c in by)
    values = F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names]))
    long_rows = patches.select(*by, values).where("value is not null and not isnan(value)")
    fields = [*by, "name"]

    def grouped(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray]]:
        """Positions of each key of a batch."""
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(len(fields))), strict=True))
        places: dict[tuple, list[int]] = {}
        for i, k in enumerate(keys):
            places.setdefault(k, []).append(i)
        yield from ((k, np.array(at)) for k, at in places.items())

    def reduced(states_of: Callable[[pa.RecordBatch, np.ndarray], np.ndarray]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple, list[float]] = {}
            schema = None
            for batch in batches:
                schema = batch.schema
                for k, at in grouped(batch):
                    state = states_of(batch, at)
                    held[k] = list(how.merge(np.array([held[k], state]))) if k in held else list(state)
            if held:
                columns = [pa.array([k[i] for k in held], schema.field(i).type) for i in range(len(fields))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(list(held.values()), pa.list_(pa.float64()))], [*fields, "state"])

        return run

    values_at = len(fields)
    parts = long_rows.mapInArrow(reduced(lambda b, at: how.part(b.column(values_at).take(pa.array(at)).to_numpy())), f"{keys}, name string, state array<double>")
    merged = parts.repartition(*fields).mapInArrow(reduced(lambda b, at: how.merge(np.array(b.column(values_at).take(pa.array(at)).to_pylist()))), f"{keys}, name string, state array<double>")

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:values_at], pa.array([float(how.finish(s)) for s in b.column(values_at).to_pylist()], pa.float64())], [*fields, "value"])

    done = merged.mapInArrow(finished, f"{keys}, name string, value double")
    pick = lambda n: F.max(F.when(F.col("name") == n, F.col("value"))).alias(n)
    return patches.select(*by).distinct().join(done.groupBy(*by).agg(*map(pick, names)), list(by), "left")


def histogram(patches: DataFrame, name: str, width: float) -> DataFrame:
    """``t, class_label, bucket, n``: patches by ``floor(value / width)``."""
    return patches.where(F.col(name).isNotNull()).groupBy("t", "class_label", F.floor(F.col(name) / width).alias("bucket")).agg(F.count("*").alias("n"))


def metrics_long(wide: DataFrame, level: str, habitat: str | None = None) -> DataFrame:
    """The long table ``t, habitat, level, class_label, name, value, unit, variant, description``."""
    names = [n for n in wide.columns if n in UNITS[level]]
    rows = [F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value"), F.lit(UNITS[level][n][0]).alias("unit"), F.lit(UNITS[level][n][1]).alias("description")) for n in names]
    label = F.col("class_label").cast("string") if "class_label" in wide.columns else F.lit(None).cast("string")
    out = wide.select("t", F.lit(habitat).cast("string").alias("habitat"), F.lit(level).alias("level"), label.alias("class_label"), F.explode(F.array(*rows)).alias("m"))
    return out.select("t", "habitat", "level", "class_label", "m.name", "m.value", "m.unit", F.lit("conventional").alias("variant"), "m.description")


def compare(one: DataFrame, other: DataFrame) -> DataFrame:
    """Two long tables side by side, with the order of their values (-1, 0, 1)."""
    keys = ["t", "level", "class_label", "name"]
    a, b = one.select(*keys, F.col("value").alias("one")), other.select(*keys, F.col("value").alias("other"))
    on = None
    for k in keys:
        on = a[k].eqNullSafe(b[k]) if on is None else on & a[k].eqNullSafe(b[k])
    return a.join(b, on).select(*[a[k] for k in keys], "one", "other", F.signum(F.col("one") - F.col("other")).cast("int").alias("order"))


def get_metric(name: str, patches: DataFrame, class_value=None, components: DataFrame | None = None, distances: DataFrame | None = None) -> DataFrame:
    """``t, value`` of one named metric, looked up by level."""
    if class_value is not None:
        if name not in UNITS["class"]:
            raise ValueError(f"{name} is no class metric")
        return class_metrics(patches, [class_value]).select("t", F.col(name).cast("double").alias("value"))
    if name in UNITS["landscape"]:
        return landscape_metrics(patches).select("t", F.col(name).cast("double").alias("value"))
    if name in UNITS["component"]:
        if components is None:
            raise ValueError(f"{name} needs components")
        return component_metrics(components, patches, distances).select("t", F.col(name).cast("double").alias("value"))
    raise ValueError(f"unknown metric {name}")
