"""Hand-drawn grids with known answers, and laws that hold on any landscape."""

import math
import random

import pytest
from pyspark.sql import functions as F

from landmosaic.components import connected_components
from landmosaic.functions import columns
from landmosaic.grid import GridSpec, clip, require_same_grid, resample_nearest, sub_window, thumbnail, window_lat_lon
from landmosaic.landscape import Landscape
from landmosaic.operators import adjacency, edits, habitat, meetings, metrics, patches, pyramid, timeline, vector
from landmosaic.operators.metrics import Metric
from landmosaic.sources import tables

GRID = GridSpec(a=1.0, e=-1.0, width=100)


def draw(spark, *pictures):
    """Cells of one picture a slice; a dot is no data."""
    rows = [(t, r, c, ch) for t, p in enumerate(pictures) for r, line in enumerate(p.split()) for c, ch in enumerate(line) if ch != "."]
    return spark.createDataFrame(rows, "t long, row long, col long, class_label string")


def labelled(spark, *pictures, connectivity=4):
    return patches.label_patches(draw(spark, *pictures), GRID, connectivity)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def brute_labels(picture, diagonal=False):
    grid = {(r, c): ch for r, line in enumerate(picture.split()) for c, ch in enumerate(line) if ch != "."}
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + [(1, 1), (1, -1), (-1, 1), (-1, -1)] * diagonal
    out = {}
    for cell in sorted(grid):
        if cell in out:
            continue
        stack, out[cell] = [cell], cell[0] * GRID.width + cell[1]
        while stack:
            r, c = stack.pop()
            for dr, dc in steps:
                n = (r + dr, c + dc)
                if n in grid and n not in out and grid[n] == grid[cell]:
                    out[n] = out[cell]
                    stack.append(n)
    return sorted((v, *k) for k, v in out.items())


@pytest.mark.parametrize("connectivity", [4, 8])
def test_labels_match_flood_fill(spark, connectivity):
    rng = random.Random(5)
    picture = " ".join("".join(rng.choice("aab.") for _ in range(23)) for _ in range(17))
    got = rows(labelled(spark, picture, connectivity=connectivity), "patch_id", "row", "col")
    assert got == brute_labels(picture, connectivity == 8)


@pytest.mark.parametrize("connectivity, most", [(4, 500_000), (8, 40)])
def test_only_borders_of_bands_take_part_in_rounds(spark, monkeypatch, connectivity, most):
    rng = random.Random(8)
    picture = " ".join("".join(rng.choice("aab.") for _ in range(9)) for _ in range(200))
    seen = []
    monkeypatch.setattr(patches, "FOREST_EDGES", most)
    monkeypatch.setattr(patches, "connected_components", lambda pairs: seen.append(pairs.count()) or connected_components(pairs))
    one = patches.label_runs(draw(spark, picture), GRID, connectivity)
    assert rows(patches.run_cells(one), "patch_id", "row", "col") == brute_labels(picture, connectivity == 8)
    if most > 40:  # three borders between four bands of 64 rows
        assert 0 < seen[0] < one.count() / 10
    assert rows(patches.patch_table(one, GRID), "patch_id", "n_cells", "perimeter") == rows(patches.patch_table(patches.run_cells(one), GRID), "patch_id", "n_cells", "perimeter")


def test_checkerboard_and_ring(spark):
    assert labelled(spark, "abab baba").select("patch_id").distinct().count() == 8
    assert labelled(spark, "abab baba", connectivity=8).select("patch_id").distinct().count() == 2
    ring = patches.patch_table(labelled(spark, "aaa aba aaa"), GRID).where("class_label = 'a'").first()
    assert (ring.n_cells, ring.area, ring.perimeter) == (8, 8.0, 16.0)
    assert (ring.xmin, ring.ymin, ring.xmax, ring.ymax) == (0.0, -3.0, 3.0, 0.0)


def test_bad_connectivity_and_empty(spark):
    with pytest.raises(ValueError):
        labelled(spark, "a", connectivity=6)
    assert labelled(spark, ".").count() == 0


def test_components_of_a_random_graph_and_a_chain(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    touched = {x for e in edges if e[0] != e[1] for x in e}
    got = connected_components(spark.createDataFrame(edges, "src long, dst long").repartition(5))
    assert {tuple(r) for r in got.collect()} == {(x, find(x)) for x in touched}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_adjacency_counts_corners(spark):
    assert rows(adjacency.adjacency(labelled(spark, "ab cd")), "src", "dst") == [(0, 1), (0, 100), (0, 101), (1, 100), (1, 101), (100, 101)]
    assert rows(adjacency.weak_nodes(*[f(labelled(spark, "a.b.. ....b")) for f in (lambda p: p, adjacency.adjacency)]), "patch_id", "degree") == [(0, 0), (2, 0), (104, 0)]


def test_distance_edges(spark):
    pc = labelled(spark, "a..b ..... c....")
    exact = {(0, 3): 2.0, (0, 200): 1.0, (3, 200): math.hypot(2, 1)}
    for limit in (0.0, 1.0, 2.0, 2.5):
        got = {(r.src, r.dst): r.distance for r in adjacency.distance_edges(pc, limit, GRID).collect()}
        assert got == pytest.approx({k: v for k, v in exact.items() if v <= limit})
    with pytest.raises(ValueError):
        adjacency.distance_edges(pc, -1.0, GRID)


def test_metric_laws(spark):
    rng = random.Random(8)
    picture = " ".join("".join(rng.choice("abc") for _ in range(20)) for _ in range(20))
    table = patches.patch_metrics(patches.patch_table(labelled(spark, picture), GRID))
    land, by_class = metrics.landscape_metrics(table).first(), metrics.class_metrics(table).collect()
    assert land.total_area == 400 and sum(r.proportion_of_landscape for r in by_class) == pytest.approx(1)
    assert land.simpson_diversity_index == pytest.approx(1 - sum(r.proportion_of_landscape**2 for r in by_class))
    assert land.shannon_diversity_index == pytest.approx(-sum(r.proportion_of_landscape * math.log(r.proportion_of_landscape) for r in by_class))
    assert table.where("area = 1 and fractal_dimension is not null").count() == 0
    assert metrics.get_metric("total_area", table, "a").first().value == next(r.total_area for r in by_class if r.class_label == "a")
    with pytest.raises(ValueError):
        metrics.get_metric("nonsense", table)
    with pytest.raises(ValueError):
        metrics.patch_aggregates(table, "nonsense")


def test_own_metric_and_comparison(spark):
    metrics.register_metric("smallest_patch", "class", lambda: F.min("area"), "CRS.unit**2")
    try:
        table = patches.patch_table(labelled(spark, "aab"), GRID)
        assert rows(metrics.class_metrics(table), "class_label", "smallest_patch") == [("a", 2.0), ("b", 1.0)]
    finally:
        metrics.UNITS["class"].pop("smallest_patch")
        metrics.EXTRA.clear()
    assert Metric(1, "x") < Metric(2, "y") and Metric(1, "x") == Metric(1, "z") and Metric(1, "x") != 1
    long = metrics.metrics_long(metrics.landscape_metrics(table), "landscape")
    assert {r.order for r in metrics.compare(long, long).collect()} == {0}


def test_absent_class_is_zero_or_null(spark):
    table = patches.patch_table(labelled(spark, "ab", "aa"), GRID)
    got = metrics.class_timeseries(table).where("t = 1 and class_label = 'b'").first()
    assert (got.num_patches, got.total_area, got.shape_index, got.largest_patch_index) == (0, 0.0, None, None)


def test_isolation_quirk(spark):
    def isolation(picture):
        pc = labelled(spark, picture)
        members = habitat.components(pc.select("t", "patch_id").distinct(), adjacency.adjacency(pc))
        sizes = patches.patch_table(pc, GRID)
        return metrics.component_metrics(members, sizes, habitat.component_distances(members, pc, GRID)).first()

    assert isolation("aa").avg_component_isolation == 0
    assert isolation("a.a").avg_component_isolation is None
    assert isolation("a.a..a").avg_component_isolation == pytest.approx((1 + 2 + 4) / 3)
    assert isolation("a.a.a").avg_component_isolation == pytest.approx((1 + 3) / 2)


def test_component_distances_and_nearest_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pyramid, "BLOCK", 7)
    rng = random.Random(4)
    pictures = ["\n".join("".join("A" if rng.random() < p else "." for _ in range(17)) for _ in range(13)) for p in (0.1, 0.4)]
    pictures.append("A" + "." * 90 + "A.A\n" + "." * 94 + "\nA")  # the first lies far from the next
    pictures.append("AAA")  # a single component
    pc = labelled(spark, *pictures)
    members = pc.select("t", F.col("patch_id").alias("component_id"), "patch_id").distinct()
    cells, want = {}, {}
    for r in pc.collect():
        cells.setdefault((r.t, r.patch_id), []).append((r.row, r.col))
    for (t, a), one in cells.items():
        for (s, b), other in cells.items():
            if t == s and a < b:
                want[t, a, b] = min(math.hypot(max(abs(y - v) - 1, 0), max(abs(x - w) - 1, 0)) for y, x in one for v, w in other)
    got = {tuple(r)[:3]: r.distance for r in habitat.component_distances(members, pc, GRID).collect()}
    assert got == pytest.approx(want)
    near = {}
    for (t, a, b), d in want.items():
        for c in (a, b):
            near[t, c] = min(d, near.get((t, c), d))
    assert {tuple(r)[:2]: r.distance for r in habitat.nearest_components(members, pc, GRID).collect()} == pytest.approx(near)


def test_barriers(spark):
    def joined(picture, **options):
        return rows(habitat.add_habitat(labelled(spark, picture), GRID, "h", ["a", "b"], max_travel_distance=2.0, **options).edges, "src", "dst")

    wall = [".X."] * 9
    wall[4] = "aXb"
    edge = [(400, 402)]
    assert joined(" ".join(wall)) == edge and joined(" ".join(wall), barrier_classes=["X"]) == []
    wall[3] = "..."
    assert joined(" ".join(wall), barrier_classes=["X"]) == edge
    assert joined("aXb", barrier_classes=["X"]) == [(0, 2)]  # around the end of a short wall
    assert joined("a.b", barrier_classes=["b"]) == [(0, 2)]  # b is a barrier: it gets its edge as the source
    with pytest.raises(ValueError):
        habitat.add_habitat(labelled(spark, "a"), GRID, "h", ["a"], max_travel_distance=-1)


def test_habitat_edges_grow_with_distance(spark):
    rng = random.Random(2)
    pc = labelled(spark, " ".join("".join(rng.choice("abcc") for _ in range(15)) for _ in range(15)))
    found = [set(rows(habitat.add_habitat(pc, GRID, "h", ["a", "b"], max_travel_distance=d).edges, "src", "dst")) for d in (0.0, 1.0, 3.0)]
    assert found[0] <= found[1] <= found[2]
    got = habitat.apply_to_habitats([habitat.add_habitat(pc, GRID, n, [n]) for n in "ab"], lambda h: h.nodes)
    assert {r.habitat for r in got.collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        habitat.apply_to_habitats([], "name")


def test_dynamics_of_hand_drawn_slices(spark):
    before, after = "aa.b.cc.d.ee", "aaab.c.cd.e."
    pc = labelled(spark, before, after)
    table = patches.patch_table(pc, GRID)
    nm = timeline.node_map(pc, "interior", GRID)
    got = {r.patch_id: (r.node_dynamic, r.absolute_growth) for r in timeline.dynamics(nm, table).collect()}
    assert got == {0: ("grew", 1.0), 3: ("unchanged", 0.0), 5: ("shrank", -1.0), 7: ("birth", 1.0), 8: ("unchanged", 0.0), 10: ("shrank", -1.0)}
    assert timeline.same_mapping(timeline.invert(timeline.invert(nm)), nm)
    assert rows(timeline.mapping_lists(nm, table), "src_id", "targets")[0] == (0, [0])
    sizes = {m: timeline.node_map(pc, m, GRID).count() for m in ("interior", "edge", "corner")}
    assert sizes["interior"] <= sizes["edge"] <= sizes["corner"]
    diff = {r.src_id: (r.removed_area, r.added_area) for r in timeline.polygon_diff(nm, table).collect()}
    assert diff[0] == (0.0, 1.0) and diff[5] == (1.0, 0.0)
    cells = timeline.polygon_diff_cells(nm, pc)
    assert rows(cells, "src_id", "col", "change") == [(0, 2, "added"), (5, 6, "removed"), (10, 11, "removed")]
    assert timeline.deaths(nm, table).count() == 0


def test_merge_and_complex(spark):
    pc = labelled(spark, "a.a.bb.b", "aaa.b.bb")
    kinds = {r.patch_id: r.node_dynamic for r in timeline.dynamics(timeline.node_map(pc), patches.patch_table(pc, GRID)).collect()}
    assert kinds[0] == "merged" and kinds[4] == "shrank"
    pc = labelled(spark, "a.a aaa a.a", "a.a ... a.a")
    assert {r.node_dynamic for r in timeline.dynamics(timeline.node_map(pc), patches.patch_table(pc, GRID)).collect()} == {"split"}
    pc = labelled(spark, "aaaa.a", "a.aaaa")
    assert {r.patch_id: r.node_dynamic for r in timeline.dynamics(timeline.node_map(pc), patches.patch_table(pc, GRID)).collect()} == {0: "split", 2: "complex"}


def test_edits(spark):
    pc = labelled(spark, "abca")
    edges = adjacency.adjacency(pc)
    cells, merged = edits.merge_nodes(pc, edges, 0, [1, 2, 77], "m")
    assert rows(merged, "src", "dst") == [(0, 4), (3, 4)] and rows(cells.where("patch_id = 4"), "class_label").count(("m",)) == 2
    with pytest.raises(ValueError):
        edits.merge_nodes(pc, edges, 0, [99], "m")
    with pytest.raises(ValueError):
        edits.merge_nodes(pc, edges, 0, [1, 2], "m", final_index=3)
    cells, merged = edits.merge_classes(pc, ["a", "b"], "x")
    assert rows(cells, "col", "patch_id") == [(0, 0), (1, 0), (2, 2), (3, 3)] and rows(merged, "src", "dst") == [(0, 2), (2, 3)]
    with pytest.raises(ValueError):
        edits.merge_classes(pc, ["q"], "x")
    cells, left = edits.remove_nodes(pc, edges, spark.createDataFrame([(0, 1)], "t long, patch_id long"))
    assert rows(left, "src", "dst") == [(2, 3)]
    table = patches.patch_table(pc, GRID)
    new = spark.createDataFrame([(0, 9, "z")], "t long, patch_id long, class_label string")
    more, grown = edits.add_nodes(table, edges, new, spark.createDataFrame([(0, 9, 1), (0, 9, 9)], "t long, src long, dst long"))
    assert more.count() == 5 and (1, 9) in rows(grown, "src", "dst") and (9, 9) not in rows(grown, "src", "dst")
    with pytest.raises(ValueError):
        edits.add_nodes(table, edges, table.limit(1), edges)
    assert rows(edits.dense_ids(table), "node_index") == [(0,), (1,), (2,), (3,)]


def test_signature_sees_shape_not_names(spark):
    sig = lambda p: (lambda pc: adjacency.graph_signature(pc.select("t", "patch_id").distinct(), adjacency.adjacency(pc)))(labelled(spark, p))
    assert adjacency.same_graph(sig("abc"), sig("xyx")) and not adjacency.same_graph(sig("abc"), sig("ab cd"))


def test_windows(spark):
    cells = draw(spark, "abcd efgh ijkl mnop")
    assert rows(sub_window(cells, (1, 3), (0, 2), 4), "class_label") == [("j",), ("k",), ("n",), ("o",)]
    assert rows(thumbnail(cells, (4, 4), 2), "row", "col", "class_label") == [(0, 0, "f"), (0, 1, "h"), (1, 0, "n"), (1, 1, "p")]
    world = GridSpec(a=1.0, c=10.0, e=-1.0, f=50.0, crs="EPSG:4326")
    assert rows(window_lat_lon(cells, world, (47, 49), (11, 13)), "class_label") == [("f",), ("g",), ("j",), ("k",)]
    # bounds inside cells: those that hold them, the later one left out
    assert rows(window_lat_lon(cells, world, (47.25, 48.75), (11.75, 13.25)), "class_label") == [("f",), ("g",)]
    for grid, lat, lon in ((GRID, (0, 1), (0, 1)), (world, (0, 91), (0, 1)), (world, (0, 1), (1, 0)), (world, (0, 1), (0, 181))):
        with pytest.raises(ValueError):
            window_lat_lon(cells, grid, lat, lon)
    assert rows(resample_nearest(cells, GRID, GridSpec(a=2.0, e=-2.0), (2, 2)), "row", "col", "class_label") == [(0, 0, "f"), (0, 1, "h"), (1, 0, "n"), (1, 1, "p")]
    triangle = spark.createDataFrame([(0.0, 0.0, 0.0, -4.0), (0.0, -4.0, 4.0, -4.0), (4.0, -4.0, 0.0, 0.0)], "x1 double, y1 double, x2 double, y2 double")
    assert rows(clip(cells, GRID, triangle), "class_label") == [(x,) for x in "eijmno"]
    with pytest.raises(ValueError):
        require_same_grid(GRID, world)


def test_columns(spark):
    one = spark.createDataFrame([(30.0984, 51.3894)], "x double, y double")
    there = columns.reproject_points(one, "EPSG:4326", "EPSG:32635").first()
    back = columns.reproject_points(columns.reproject_points(one, "EPSG:4326", "EPSG:32635"), "EPSG:32635", "EPSG:4326").first()
    assert there.x == pytest.approx(715_600, abs=500) and there.y == pytest.approx(5_697_600, abs=500)
    assert (back.x, back.y) == pytest.approx((30.0984, 51.3894), abs=1e-9)
    with pytest.raises(ValueError):
        columns.reproject_points(one, "EPSG:4326", "EPSG:3857")
    hit = spark.createDataFrame([("212101212", "FF2F11212")], "a string, b string").select(columns.match_relate(F.col("a"), "T********"), columns.match_relate(F.col("b"), "T********"), columns.match_relate(F.col("b"), "FF*F1****")).first()
    assert tuple(hit) == (True, False, True)
    assert spark.range(1).select(columns.dynamic_number(F.lit("birth")), columns.hectares(F.lit(20_000)), columns.kilometres(F.lit(500))).first()[0] == 6


def test_places_beyond_the_grid_are_errors(spark):
    for row, col in ((-1, 0), (0, -1), (0, GRID.width), (1 << 24, 0)):
        cells = spark.createDataFrame([(0, row, col, "a")], "t long, row long, col long, class_label string")
        with pytest.raises(Exception, match="rows must lie"):
            patches.label_patches(cells, GRID).count()


def test_first_slice_and_sizes(spark, tmp_path):
    cells = draw(spark, "aab acb", "aaa ccc")
    assert timeline.previous_time(cells, 1) == 0
    with pytest.raises(UserWarning):
        timeline.previous_time(cells, 0)
    with pytest.raises(KeyError):
        timeline.previous_time(cells, 7)
    land = Landscape(cells, GRID)
    land.add_habitat("c", ["c"])
    assert rows(land.graph_sizes().where("habitat is null"), "t", "nodes", "edges") == [(0, 3, 3), (1, 2, 1)]
    assert rows(land.graph_sizes().where("habitat = 'c'"), "t", "nodes", "edges") == [(0, 1, 0), (1, 1, 0)]
    assert rows(land.bounds, "t", "xmin", "ymin", "xmax", "ymax") == [(0, 0.0, -2.0, 3.0, 0.0), (1, 0.0, -2.0, 3.0, 0.0)]
    levels = rows(land.metrics_of_graphs().groupBy("habitat", "level").count().fillna("-"), "habitat", "level")
    assert levels == sorted((h, x) for h in ("-", "c") for x in ("landscape", "class", "component"))
    land.save(str(tmp_path / "land"))
    again = Landscape.load(spark, str(tmp_path / "land"))
    again.save(str(tmp_path / "land"), overwrite=True)
    again = Landscape.load(spark, str(tmp_path / "land"))
    assert again.grid == GRID and rows(again.cells, "t", "row", "col", "patch_id") == rows(land.cells, "t", "row", "col", "patch_id")


@pytest.mark.parametrize("most", [500_000, 7])
def test_runs_meet_across_bands_and_batches(spark, monkeypatch, most):
    monkeypatch.setattr(meetings, "HELD", most)
    rng = random.Random(most)
    grid = {(t, r, c): rng.choice([1, 1, 2, 3]) for t in "xy" for r in [*range(-3, 70), *range(120, 131)] for c in range(-4, 9) if rng.random() < 0.9}
    cells = spark.createDataFrame([(t, p, r, c, "a") for (t, r, c), p in grid.items()], "t string, patch_id long, row long, col long, class_label string").repartition(3)
    beside, shared, inner = {}, {}, {}
    for (t, r, c), p in grid.items():
        if grid.get((t, r + 1, c)) == p:
            inner[t, p] = inner.get((t, p), 0) + 1
        for dr, dc in ((0, 1), (1, -1), (1, 0), (1, 1)):
            if (q := grid.get((t, r + dr, c + dc))) and q != p:
                key = (t, min(p, q), max(p, q))
                beside[key], shared[key] = beside.get(key, 0) + (dr == 0), shared.get(key, 0) + (dc == 0)
    assert rows(adjacency.adjacency(cells), "t", "src", "dst") == sorted(beside)
    found = adjacency.bordered_edges(cells, GridSpec(a=2.0, e=-7.0, width=100))
    assert rows(found, "t", "src", "dst", "border") == sorted((*k, 7.0 * beside[k] + 2.0 * shared[k]) for k in beside)
    assert rows(patches.inner_sides(patches.stored_runs(cells)), "t", "patch_id", "inner") == sorted((*k, n) for k, n in inner.items())


def test_runs_move_once_to_meet(spark):
    runs = patches.stored_runs(labelled(spark, "aab acb"))
    moves = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    assert moves(adjacency.contacts(runs)) == 1 and moves(patches.inner_sides(runs)) == 2  # the sums move too


def test_only_runs_of_patches_at_a_border_move_for_their_patch(spark):
    picture = " ".join("a" + "bc"[r // 3 % 2] + "de"[r % 2] for r in range(100))
    one = patches.rooted(patches.runs(draw(spark, picture)), 0).collect()
    edge = {r.root for r in one if r.row in (0, 63, 64, 99)}
    assert {r.root for r in one if r.loose} == edge and sum(r.loose for r in one) < len(one) / 2
    assert all(r.loose == (r.root in edge) for r in one)


def test_runs_merge_as_cells_do(spark):
    rng = random.Random(12)
    picture = " ".join("".join(rng.choice("abc.") for _ in range(12)) for _ in range(20))
    one = patches.stored_runs(labelled(spark, picture, picture[::-1]))
    got, edges = edits.merge_classes(one, ["a", "b"], "new")
    want, same = edits.merge_classes(patches.run_cells(one), ["a", "b"], "new")
    cols = ("t", "patch_id", "class_label", "row")
    assert rows(patches.run_cells(got), *cols, "col") == rows(want, *cols, "col") and rows(edges, "t", "src", "dst") == rows(same, "t", "src", "dst")
    assert rows(got, *cols, "c0", "c1") == rows(patches.patch_runs(want), *cols, "c0", "c1")


def test_saved_tables_are_not_computed_again(spark, tmp_path):
    land, path = Landscape(draw(spark, "aab abc", "abb abb"), GRID), str(tmp_path / "land")
    land.save(path)
    again = Landscape.load(spark, path)
    assert "Exchange" not in again.patches._jdf.queryExecution().executedPlan().toString() + again.edges._jdf.queryExecution().executedPlan().toString()
    assert rows(again.patches, *land.patches.columns) == rows(land.patches, *land.patches.columns) and rows(again.edges, "t", "src", "dst") == rows(land.edges, "t", "src", "dst")
    assert rows(Landscape.load(spark, path, GridSpec(a=2.0, e=-2.0, width=100)).patches, "t", "area") == [(t, 4 * x) for t, x in rows(land.patches, "t", "area")]
    # tables that a caller stores beside cells may be others than those of the cells
    tables.write_landscape(path, land.cells, land.patches.where("t = 0"), land.edges, overwrite=True, grid=GRID)
    assert Landscape.load(spark, path).patches.count() == land.patches.count()


def test_aggregators_of_series_and_absent_classes(spark):
    table = patches.patch_metrics(patches.patch_table(labelled(spark, "aab acb"), GRID))
    assert rows(metrics.patch_aggregates(table, metrics.of_series(lambda v: v.max())), "class_label", "area") == [("a", 3.0), ("b", 2.0), ("c", 1.0)]
    found = metrics.class_metrics(table, ["a", "nowhere"])
    assert rows(found, "class_label", "num_patches", "total_area", "edge_density") == [("a", 1, 3.0, 8.0 / 3), ("nowhere", 0, 0.0, None)]


SQUARE = [[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]]]


def polygons(spark, *shapes):
    schema = "patch_id long, class_label string, geometry array<array<array<struct<x: double, y: double>>>>"
    return vector.vector_patches(spark.createDataFrame([(i, "a", s) for i, s in enumerate(shapes)], schema))


def shifted(shape, dx, dy):
    return [[[(x + dx, y + dy) for x, y in ring] for ring in part] for part in shape]


def test_polygons(spark):
    holed = [[[(0.0, 0.0), (3.0, 0.0), (3.0, 3.0), (0.0, 3.0)], [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (2.0, 1.0)]]]
    row = polygons(spark, holed).first()
    assert (row.area, row.perimeter) == (8.0, 16.0) and row.rep_x in (0.5, 2.5)
    table = polygons(spark, SQUARE, shifted(SQUARE, 1, 0), shifted(SQUARE, 1, 1), shifted(SQUARE, 0.5, 0.5), shifted(SQUARE, 4, 0))
    got = {(r.one_id, r.other_id): (r.contact, round(r.overlap, 9)) for r in vector.relations(table).collect()}
    assert got == {(0, 1): ("edge", 0), (0, 2): ("corner", 0), (0, 3): ("interior", 0.25), (1, 2): ("edge", 0), (1, 3): ("interior", 0.25), (2, 3): ("interior", 0.25)}
    far = {(r.src, r.dst): round(r.distance, 9) for r in vector.vector_edges(table, 2.0).collect()}
    assert far[1, 4] == 2.0 and (0, 4) not in far
    with pytest.raises(ValueError):
        vector.vector_edges(table, -1.0)
    with pytest.raises(ValueError):
        vector.vector_patches(spark.range(1))


def test_contact_at_large_coordinates_and_empty_geometries(spark):
    x, y = 700_000.1, 5_700_000.3
    table = polygons(spark, shifted(SQUARE, x, y), shifted(SQUARE, x + 1, y), shifted(SQUARE, x + 2, y + 1), [], None, shifted(SQUARE, x + 900, y))
    assert {(r.one_id, r.other_id): r.contact for r in vector.relations(table).collect()} == {(0, 1): "edge", (1, 2): "corner"}
    assert rows(table.where("patch_id in (3, 4)"), "area", "perimeter") == [(0.0, 0.0), (0.0, 0.0)]


def test_concave_overlap_and_containment(spark):
    one = [[[(0.0, 0.0), (1.0, 3.0), (2.0, 1.0), (3.0, 3.0), (4.0, 0.0)]]]
    other = [[[(0.5, 0.5), (0.5, 2.5), (3.7, 1.9), (3.0, 0.2)]]]
    assert vector.relations(polygons(spark, one, other)).first().overlap == pytest.approx(4.438204, abs=1e-6)
    inner = [[[(0.4, 0.4), (0.6, 0.4), (0.6, 0.6), (0.4, 0.6)]]]
    row = vector.relations(polygons(spark, SQUARE, inner)).first()
    assert row.contact == "interior" and row.distance == 0 and row.overlap == pytest.approx(0.04)


def test_sources(spark, tmp_path):
    raster = spark.createDataFrame([(0, [1, 2, None])], "row int, values array<int>")
    assert rows(tables.cells_from_rows(raster), "col", "class_label") == [(0, "1"), (1, "2")]
    bands = spark.createDataFrame([(0, 0, 5, 1), (0, 0, 6, 2)], "row int, col int, value int, band int")
    assert rows(tables.cells_from_table(bands), "class_label") == [("5",)]
    (tmp_path / "roi.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"name":"exclusion zone"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}}]}')
    found = tables.read_geojson(spark, str(tmp_path / "roi.json"), contains="zone").first()
    assert found.name == "exclusion zone" and len(found.geometry[0][0]) == 4
    (tmp_path / "legend.csv").write_text("code;text\n10;cropland\n")
    assert rows(tables.read_legend(spark, str(tmp_path / "legend.csv"), "code", "text"), "class_label", "label") == [("10", "cropland")]
    land = Landscape(draw(spark, "aab abb", "abb abb"), GRID)
    land.save(str(tmp_path / "land"))
    with pytest.raises(Exception, match="exist"):
        land.save(str(tmp_path / "land"))
    land.save(str(tmp_path / "land"), overwrite=True)
    again = Landscape.load(spark, str(tmp_path / "land"), GRID)
    assert again.cells.count() == 12 and len(again) == 2
    h = land.add_habitat("h", ["a"], max_travel_distance=1.0, add_distance=True)
    tables.write_habitat(str(tmp_path / "h"), h)
    assert tables.read_habitat(spark, str(tmp_path / "h")).edges.count() == h.edges.count()
    assert land.metrics_of_graphs().where("habitat = 'h' and level = 'component'").count() == 4
    assert land.dynamics().count() == 2 and land[0].patches.count() == 2
    with pytest.raises(KeyError):
        land[7]
    with pytest.raises(NotImplementedError):
        timeline.stack_slices([])


def test_many_sided_polygons(spark):
    ring = lambda x, y, r, n=400: [(x + r * math.cos(2 * math.pi * k / n), y + r * math.sin(2 * math.pi * k / n)) for k in range(n)]
    area = lambda r, n=400: n / 2 * r * r * math.sin(2 * math.pi / n)
    shapes = [[ring(0, 0, 50)], [ring(3, 4, 2)], [ring(60, 0, 20)], [ring(0, 200, 30), ring(0, 200, 20)], [ring(0, 200, 10)], [ring(0, 60.5, 10)]]
    rows = [(i, "x", [[[{"x": x, "y": y} for x, y in r] for r in rings]]) for i, rings in enumerate(shapes)]
    table = vector.vector_patches(spark.createDataFrame(rows, "patch_id long, class_label string, geometry array<array<array<struct<x:double,y:double>>>>"))
    got = {(r.one_id, r.other_id): r for r in vector.relations(table, None, 12.0).collect()}
    assert set(got) == {(0, 1), (0, 2), (0, 5), (3, 4)}
    assert got[0, 1].contact == "interior" and got[0, 1].overlap == pytest.approx(area(2))  # inside, far from the outline
    assert got[0, 2].contact == "interior" and 0 < got[0, 2].overlap < area(20)
    assert got[0, 5].contact == "none" and got[0, 5].distance == pytest.approx(0.5) and got[0, 5].overlap == pytest.approx(0, abs=1e-6)
    assert got[3, 4].contact == "none" and got[3, 4].distance == pytest.approx(10.0, abs=0.01)  # in the hole


@pytest.mark.parametrize("distance", [0.0, 29.0, 30.0, 75.0, 130.0])
def test_reach_against_every_cell(spark, distance):
    """Oblong cells, patches with holes and gaps, repeated cells, rows above the landscape's edge."""
    grid = GridSpec(a=20.0, e=-30.0, width=64)
    own = {(1, 5): [(0, 0), (0, 1), (0, 4), (3, 9)], (1, 7): [(2, 2), (2, 2), (3, 2)], (2, 5): [(0, 30)]}
    rows = [(t, p, r, c) for (t, p), cells in own.items() for r, c in cells]
    found = [tuple(r) for r in habitat.reach(spark.createDataFrame(rows, "t long, patch_id long, row long, col long"), distance, grid).select("t", "patch_id", "row", "col").collect()]
    near = lambda r, c, y, x: math.hypot(max(abs(r - y) - 1, 0) * 30.0, max(abs(c - x) - 1, 0) * 20.0) <= distance
    want = {(t, p, y, x) for (t, p), cells in own.items() for y in range(-9, 14) for x in range(-12, 44) if any(near(r, c, y, x) for r, c in cells)}
    assert sorted(found) == sorted(want)
    empty = spark.createDataFrame([], "t long, patch_id long, row long, col long")
    assert habitat.reach(empty, distance, grid).count() == 0
