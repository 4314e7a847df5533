"""Reading landscapes from tables and writing them as Parquet."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from landmosaic.grid import GridSpec


def cells_from_rows(rows: DataFrame, row_col: str = "row", values: str = "values", t=0) -> DataFrame:
    """Cells of a raster stored as one array of class codes per row."""
    out = rows.select(F.lit(t).alias("t"), F.col(row_col).cast("long").alias("row"), F.posexplode(values).alias("col", "value"))
    return out.where("value is not null").select("t", "row", F.col("col").cast("long").alias("col"), F.col("value").cast("string").alias("class_label"))


def cells_from_table(table: DataFrame, row: str = "row", col: str = "col", value: str = "value", t: str | None = None, band: int | None = 1, band_col: str = "band") -> DataFrame:
    """Cells of a raster stored as one row per pixel; the band filter reaches the scan."""
    df = table.where(F.col(band_col) == band) if band is not None and band_col in table.columns else table
    time = F.col(t) if t else F.lit(0)
    return df.where(F.col(value).isNotNull()).select(time.alias("t"), F.col(row).cast("long").alias("row"), F.col(col).cast("long").alias("col"), F.col(value).cast("string").alias("class_label"))


def read_geojson(spark: SparkSession, path: str, name: str | None = None, contains: str | None = None) -> DataFrame:
    """``name, geometry`` of the features of a GeoJSON collection, by name or part of it."""
    ring = "array<array<double>>"
    schema = "features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    coordinates = F.col("f.geometry.coordinates")
    multi = F.from_json(coordinates, f"array<array<{ring}>>")
    single = F.array(F.from_json(coordinates, f"array<{ring}>"))
    points = lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    shape = F.when(F.col("f.geometry.type") == "MultiPolygon", multi).otherwise(single)
    out = rows.where(F.col("f.geometry.type").isin("Polygon", "MultiPolygon")).select(F.col("f.properties")["name"].alias("name"), F.transform(shape, lambda part: F.transform(part, points)).alias("geometry"))
    out = out.where(F.col("name") == name) if name is not None else out
    return out.where(F.col("name").contains(contains)) if contains is not None else out


def read_legend(spark: SparkSession, path: str, key: str, label: str) -> DataFrame:
    """``class_label, label`` of a semicolon-separated legend."""
    rows = spark.read.option("sep", ";").option("header", True).csv(path)
    return rows.select(F.col(key).cast("string").alias("class_label"), F.col(label).alias("label"))


# --- stored landscapes and habitats -------------------------------------------------
#
# A store is a folder of versions.  Each write puts its tables into a folder of its
# own and then states, in one new file, which tables make up the version, with their
# schemas and settings.  That file is the commit: until it is there, readers see the
# version before, and a table may be written over the very store it was read from.

#: Versions whose tables stay: one that is being read outlives the next write.
KEPT_VERSIONS = 2
MANIFESTS = "manifests"


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions of a store, rising."""
    fs, folder = _file_system(spark, f"{path}/{MANIFESTS}")
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n[: -len(".json")]) for n in names if n.endswith(".json") and n[: -len(".json")].isdigit())


def _manifest(spark: SparkSession, path: str, version: int) -> dict:
    return json.loads(spark.read.text(f"{path}/{MANIFESTS}/{version:08d}.json", wholetext=True).first()[0])


def write_snapshot(spark: SparkSession, path: str, tables: dict[str, DataFrame], about: dict, overwrite: bool = False, compression: str = "zstd") -> int:
    """A new version of the store; an existing store is kept unless told otherwise, and two writers never share a version."""
    known = _versions(spark, path)
    if known and not overwrite:
        raise FileExistsError(f"{path} exists already")
    version = (known[-1] if known else 0) + 1
    folder = f"v{version:08d}-{uuid.uuid4().hex}"
    for name, df in tables.items():
        out = df.write.option("compression", compression)
        if "t" in df.columns:  # files by slice, from a copy, so that t keeps its type
            copy = free_column(df.columns, "slice")
            out = df.withColumn(copy, F.col("t").cast("string")).write.option("compression", compression).partitionBy(copy)
        out.parquet(f"{path}/{folder}/{name}")
    schemas = {name: df.schema.jsonValue() for name, df in tables.items()}
    fs, draft = _file_system(spark, f"{path}/{MANIFESTS}/{folder}.draft")
    stream = fs.create(draft, False)
    stream.write(bytearray(json.dumps({"folder": folder, "schemas": schemas, "about": about}), "utf-8"))
    stream.close()
    _, target = _file_system(spark, f"{path}/{MANIFESTS}/{version:08d}.json")
    if fs.exists(target) or not fs.rename(draft, target):
        raise FileExistsError(f"another writer stored version {version} of {path}")
    for old in known[: len(known) + 1 - KEPT_VERSIONS]:
        gone = _manifest(spark, path, old)["folder"]
        for place in (f"{path}/{MANIFESTS}/{old:08d}.json", f"{path}/{gone}"):
            fs, target = _file_system(spark, place)
            fs.delete(target, True)
    return version


def read_snapshot(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    """The tables and settings of the latest version."""
    known = _versions(spark, path)
    if not known:
        raise FileNotFoundError(f"nothing is stored in {path}")
    found = _manifest(spark, path, known[-1])
    load = lambda name, schema: spark.read.schema(StructType.fromJson(schema)).parquet(f"{path}/{found['folder']}/{name}").select([f["name"] for f in schema["fields"]])
    return {name: load(name, schema) for name, schema in found["schemas"].items()}, found["about"]


def free_column(taken: list[str], name: str) -> str:
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def write_landscape(path: str, cells: DataFrame, patches: DataFrame, edges: DataFrame, overwrite: bool = False, compression: str = "zstd", grid: GridSpec | None = None, derived: bool = False) -> None:
    """Cells, nodes, edges and the grid as one version; an existing landscape is kept unless told otherwise.

    ``derived`` tells that nodes and edges are just what follows from the cells on the grid.
    """
    about = {"grid": asdict(grid) if grid else None, "derived": derived}
    write_snapshot(cells.sparkSession, path, {"cells": cells, "nodes": patches, "edges": edges}, about, overwrite, compression)


def read_grid(spark: SparkSession, path: str) -> GridSpec:
    """The grid and CRS that a landscape was written with."""
    about = read_snapshot(spark, path)[1]
    if not about["grid"]:
        raise ValueError(f"the landscape in {path} was stored without a grid")
    return GridSpec(**about["grid"])


@dataclass
class Stored:
    cells: DataFrame
    nodes: DataFrame
    edges: DataFrame
    grid: GridSpec | None = None
    derived: bool = False


def read_landscape(spark: SparkSession, path: str) -> Stored:
    found, about = read_snapshot(spark, path)
    return Stored(found["cells"], found["nodes"], found["edges"], GridSpec(**about["grid"]) if about["grid"] else None, about.get("derived", False))


def write_habitat(path: str, habitat, overwrite: bool = False, compression: str = "zstd") -> None:
    """Nodes, edges and settings of a habitat as one version."""
    about = {name: getattr(habitat, name) for name in ("name", "valid_classes", "barrier_classes", "max_travel_distance", "add_distance")}
    write_snapshot(habitat.nodes.sparkSession, path, {"nodes": habitat.nodes, "edges": habitat.edges}, about, overwrite, compression)


def read_habitat(spark: SparkSession, path: str):
    from landmosaic.operators.habitat import Habitat

    found, about = read_snapshot(spark, path)
    return Habitat(about["name"], found["nodes"], found["edges"], about["valid_classes"], about["barrier_classes"], about["max_travel_distance"], about["add_distance"])


def write_patches(patches: DataFrame, path: str, overwrite: bool = False) -> None:
    if not path.endswith((".parquet", "/")):
        raise ValueError("patches are stored as .parquet")
    patches.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
