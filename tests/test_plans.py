"""How joins are carried out, whatever Spark takes the sizes of stored tables for."""

import random
import re

from pyspark.sql import functions as F

from landmosaic.operators import adjacency, habitat, metrics, outlines, pyramid
from landmosaic.storage import materialize
from tests.test_landscape import GRID, labelled


def through_driver(df):
    """The keys of the joins for which a side is sent to every task, but for those by slice alone, as slices are few."""
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "extended").split("== Physical Plan ==")[1]
    assert "Join" in plan
    return [keys for keys in re.findall(r"Broadcast(?:HashJoin \[(.*?)\]|NestedLoopJoin)", plan) if not re.fullmatch(r"t#\d+L?", keys)]


def patchy(spark, seed=3):
    rng = random.Random(seed)
    return materialize(labelled(spark, *[" ".join("".join(rng.choice("ab...") for _ in range(20)) for _ in range(15)) for _ in range(2)]))


def test_runs_in_reach_do_not_meet_through_the_driver(spark):
    edges = adjacency.distance_edges(patchy(spark), 2.0, GRID)
    for df in (edges, edges.select("t", "src", "dst"), adjacency.graph_counts(edges.select("t", F.col("src").alias("patch_id")), edges)):
        assert through_driver(df) == []


def members_of(pc):
    nodes = pc.select("t", "patch_id").distinct()
    return materialize(habitat.components(nodes, adjacency.distance_edges(pc, 1.0, GRID)))


def kept(monkeypatch, module, name="materialize"):
    """The tables that a module's function of that name is given from now on."""
    given = []
    real = getattr(module, name)
    monkeypatch.setattr(module, name, lambda df, *more: given.append(df) or real(df, *more))
    return given


def test_vertices_of_components_are_not_sent_through_the_driver(spark, monkeypatch):
    given = kept(monkeypatch, habitat, "connected_components")
    found = members_of(patchy(spark))
    assert len(given) == 1 and through_driver(given[0]) == []
    least = found.groupBy("t", "component_id").agg(F.min("patch_id").alias("m"))
    assert found.count() and least.where("m <> component_id").isEmpty()


def test_members_are_not_sent_through_the_driver(spark, monkeypatch):
    pc = patchy(spark)
    members = members_of(pc)
    assert through_driver(habitat.component_cells(members, pc)) == []
    given = kept(monkeypatch, habitat)
    habitat.component_runs(members, pc)
    assert len(given) == 1 and through_driver(given[0]) == []


def test_sets_of_blocks_are_not_sent_through_the_driver(spark):
    pc = patchy(spark)
    runs, small, _ = habitat.sized_components(members_of(pc), pc)
    assert through_driver(outlines.packed(runs, small.select("t", "c", F.lit(0).cast("long").alias("block")))) == []


def test_areas_of_components_are_not_sent_through_the_driver(spark):
    pc = patchy(spark)
    sizes = materialize(pc.groupBy("t", "patch_id").agg(F.count("*").cast("double").alias("area")))
    assert through_driver(metrics.component_metrics(members_of(pc), sizes)) == []


def test_boxes_do_not_meet_through_the_driver(spark, monkeypatch):
    pc = patchy(spark)
    members = members_of(pc)
    given = kept(monkeypatch, pyramid)
    habitat.nearest_components(members, pc, GRID).collect()
    monkeypatch.setattr(habitat.outlines, "RUNS", 3)  # some components are too large for a block
    habitat.component_distances(members, pc, GRID).collect()
    joined = [df for df in given if "Join" in df._jdf.queryExecution().executedPlan().toString()]
    assert len(joined) > 5 and [keys for df in joined for keys in through_driver(df)] == []
