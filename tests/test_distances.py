"""Distance, barrier, box and graph operators against brute force, and stores that outlive their writers."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from landmosaic.grid import GridSpec
from landmosaic.landscape import Landscape
from landmosaic.operators import adjacency, edits, habitat, metrics, patches, pyramid, spans, vector
from landmosaic.sources import tables
from tests.test_landscape import GRID, labelled, polygons, rows

CELLS = "t long, patch_id long, row long, col long, class_label string"


def drawn(seed, rows, cols, p, labels="ab"):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(labels) if rng.random() < p else "." for _ in range(cols)) for _ in range(rows))


def by_patch(pc, good=None):
    out = {}
    for r in pc.collect():
        if good is None or r.class_label in good:
            out.setdefault((r.t, r.patch_id), []).append((r.row, r.col))
    return {k: np.array(v) for k, v in out.items()}


def gap(one, other, dx, dy):
    d = np.maximum(np.abs(one[:, None] - other[None]) - 1, 0) * np.array([dy, dx])
    return float(np.sqrt((d**2).sum(axis=2)).min())


@pytest.mark.parametrize("distance", [0.0, 20.0, 75.0, 500.0])
def test_distance_edges_against_every_cell(spark, distance):
    grid = GridSpec(a=20.0, e=-30.0, width=200)
    wide = ["." * 190 + "a"] + ["a" * 150 + "." * 50] + [drawn(3, 1, 180, 0.1)] * 3
    pc = patches.label_patches(spark.createDataFrame([(t, r, c, ch) for t, p in enumerate([drawn(1, 14, 30, 0.35), " ".join(wide)]) for r, line in enumerate(p.split()) for c, ch in enumerate(line) if ch != "."], "t long, row long, col long, class_label string"), grid)
    cells = by_patch(pc)
    want = {(t, a, b): d for t, a in cells for s, b in cells if s == t and a < b and (d := gap(cells[t, a], cells[t, b], 20.0, 30.0)) <= distance}
    got = {(r.t, r.src, r.dst): r.distance for r in adjacency.distance_edges(pc, distance, grid).collect()}
    assert got == pytest.approx(want)


def test_spans(spark):
    make = lambda found: spark.createDataFrame(found, "t long, patch_id long, row long, c0 long, c1 long")
    walls = make([(0, 9, 0, 3, 4), (0, 8, 0, 5, 5), (0, 8, 0, 90, 400), (0, 8, 1, 0, 9), (1, 8, 0, 0, 9)])
    some = make([(0, 1, 0, 0, 500), (0, 1, 1, 2, 5), (0, 2, 0, 4, 5), (0, 2, 0, 7, 8), (0, 2, 2, 1, 1)])
    assert rows(spans.without(some, walls, ["t", "patch_id"]), "patch_id", "row", "c0", "c1") == [(1, 0, 0, 2), (1, 0, 6, 89), (1, 0, 401, 500), (2, 0, 7, 8), (2, 2, 1, 1)]
    assert rows(spans.merged_spans(make([(0, 1, 0, 5, 9), (0, 1, 0, 1, 3), (0, 1, 0, 4, 4), (0, 1, 0, 11, 12), (0, 1, 1, 4, 4)])), "row", "c0", "c1") == [(0, 1, 9), (0, 11, 12), (1, 4, 4)]


def test_walls_are_met_once(spark):
    make = lambda found: spark.createDataFrame(found, "t long, patch_id long, row long, c0 long, c1 long")
    walls = make([(0, 9, 0, 3, 4), (0, 8, 0, 5, 5), (0, 8, 0, 90, 400), (0, 8, 1, 0, 9)])
    some, key = make([(0, 1, 0, 0, 500), (0, 1, 1, 2, 5), (0, 2, 0, 3, 4), (0, 2, 0, 5, 8), (0, 2, 2, 1, 1)]), ["t", "patch_id"]
    met = spans.met_walls(some, walls, key)
    assert rows(met, "patch_id", "row", "l0", "r0", "r1") == [(1, 0, 0, 3, 5), (1, 0, 0, 90, 400), (1, 1, 2, 0, 9), (2, 0, 3, 3, 5), (2, 0, 5, 3, 5)]
    left = spans.without(some, walls, key, met=met)
    assert rows(left, "patch_id", "row", "c0", "c1") == [(1, 0, 0, 2), (1, 0, 6, 89), (1, 0, 401, 500), (2, 0, 6, 8), (2, 2, 1, 1)]
    assert left._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # spans and walls, and nothing after them


def test_boxes_stand_in_few_squares(spark):
    boxes = spark.range(256).selectExpr("id div 16 as a_br", "id % 16 as a_bc")
    near, own = pyramid.in_squares(boxes, "a", 1), pyramid.in_squares(boxes.withColumnsRenamed({"a_br": "b_br", "a_bc": "b_bc"}), "b", 0)
    assert (near.count(), own.count()) == (576, 256)  # nine of each, and 2304, if every neighbour had a row
    met = near.join(own, ["pr", "pc"]).where("abs(a_br - b_br) <= 1 and abs(a_bc - b_bc) <= 1")
    assert met.count() == met.distinct().count() == (3 * 16 - 2) ** 2


def reachable(grid_cells, good, barriers, distance):
    """Pairs of patches of one slice by flood fill around each source, from its representative cell."""
    wall = {k for k, label in grid_cells.items() if label in barriers}
    out = set()
    for source, (label, cells, home) in good.items():
        own = {tuple(x) for x in cells}
        r = math.floor(distance) + 1
        free = set()
        for y, x in own:
            free |= {(v, w) for v in range(y - r, y + r + 1) for w in range(x - r, x + r + 1) if math.hypot(max(abs(v - y) - 1, 0), max(abs(w - x) - 1, 0)) <= distance}
        free = (free - wall) | (own & wall)
        todo, seen = [home], {home}
        while todo:
            y, x = todo.pop()
            for n in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if n in free and n not in seen:
                    seen.add(n)
                    todo.append(n)
        for target, (kind, other, _) in good.items():
            if target != source and kind not in barriers and seen & {tuple(x) for x in other}:
                out.add((min(source, target), max(source, target)))
    return out


@pytest.mark.parametrize(("distance", "barriers"), [(3.0, ["X"]), (20.0, ["X"]), (4.0, ["X", "b"])])
def test_barriers_against_flood_fill(spark, distance, barriers):
    rng = random.Random(6)
    walls = {(r, c) for r in range(30) for c in (11, 25) if rng.random() < 0.9} | {(17, c) for c in range(36) if rng.random() < 0.85}
    base = drawn(12, 30, 36, 0.09).split()
    picture = " ".join("".join("X" if (r, c) in walls else base[r][c] for c in range(36)) for r in range(30))
    pc = labelled(spark, picture)
    grid_cells = {(r.row, r.col): r.class_label for r in pc.collect()}
    reps = {r.patch_id: (r.class_label, (int(-r.rep_y), int(r.rep_x))) for r in patches.patch_table(pc, GRID).collect()}
    good = {p: (reps[p][0], cells, reps[p][1]) for (_, p), cells in by_patch(pc, "ab").items()}
    got = rows(habitat.add_habitat(pc, GRID, "h", ["a", "b"], barrier_classes=barriers, max_travel_distance=distance).edges, "src", "dst")
    assert got == sorted(reachable(grid_cells, good, barriers, distance)) and got
    assert len(got) < adjacency.distance_edges(pc.where("class_label in ('a', 'b')"), distance, GRID).count()


def test_component_distances_compare_few_cells(spark):
    pc = labelled(spark, drawn(9, 60, 90, 0.75, "a"), "\n".join(["aaaa.aaaa"] * 30))
    cells = by_patch(pc)
    members = pc.select("t", F.col("patch_id").alias("component_id"), "patch_id").distinct()
    tally = []
    got = {tuple(r)[:3]: r.distance for r in habitat.component_distances(members, pc, GRID, tally).collect()}
    assert got == pytest.approx({(t, a, b): gap(cells[t, a], cells[t, b], 1, 1) for t, a in cells for s, b in cells if s == t and a < b})
    pairs = sum(len(cells[t, a]) * len(cells[t, b]) for t, a in cells for s, b in cells if s == t and a < b)
    assert sum(tally) < 0.05 * pairs, (tally, pairs)
    near = {}
    for (t, a, b), d in got.items():
        for c in (a, b):
            near[t, c] = min(d, near.get((t, c), d))
    assert {tuple(r)[:2]: r.distance for r in habitat.nearest_components(members, pc, GRID).collect()} == pytest.approx(near)


def test_component_distances_in_blocks_store_no_pairs(spark, monkeypatch):
    rng = random.Random(4)
    picture = " ".join("".join("a" if rng.random() < 0.3 else "." for _ in range(7)) for _ in range(90)) + " aaaaaaa" + " a......" * 8
    pc = labelled(spark, picture)
    cells = by_patch(pc)
    members = pc.select("t", F.col("patch_id").alias("component_id"), "patch_id").distinct()
    want = {(t, a, b): gap(cells[t, a], cells[t, b], 1, 1) for t, a in cells for s, b in cells if s == t and a < b}
    monkeypatch.setattr(habitat.outlines, "BLOCK", 11)
    for most, mixed in ((2048, False), (5, True)):  # with and without components that are too large for a block
        monkeypatch.setattr(habitat.outlines, "RUNS", most)
        kept = []
        real = pyramid.materialize
        monkeypatch.setattr(pyramid, "materialize", lambda df, real=real, kept=kept: kept.append(df.columns) or real(df))
        got = {tuple(r)[:3]: r.distance for r in habitat.component_distances(members, pc, GRID).collect()}
        monkeypatch.setattr(pyramid, "materialize", real)
        assert got == pytest.approx(want) and len(got) > 1000
        assert mixed == any("src" in c for c in kept)


def test_distinct_distances_are_few_however_many_pairs(spark, monkeypatch):
    rng = random.Random(8)
    pc = labelled(spark, " ".join("".join("a" if rng.random() < 0.3 else "." for _ in range(8)) for _ in range(150)), " ".join(["a.a", "...", "aa."]))
    cells = by_patch(pc)
    members = pc.select("t", F.col("patch_id").alias("component_id"), "patch_id").distinct()
    pairs = [(t, gap(cells[t, a], cells[t, b], 2, 1)) for t, a in cells for s, b in cells if s == t and a < b]
    monkeypatch.setattr(habitat.outlines, "BLOCK", 11)
    monkeypatch.setattr(habitat.outlines, "PARTS", 2)
    given = []
    real = habitat.distinct_block_distances
    monkeypatch.setattr(habitat, "distinct_block_distances", lambda *a: given.append(real(*a)) or given[-1])
    for most, held in ((2048, 1 << 22), (6, 40)):  # with tasks that have to let go and components too large for a block
        monkeypatch.setattr(habitat.outlines, "RUNS", most)
        monkeypatch.setattr(habitat.outlines, "HELD", held)
        found = habitat.distinct_distances(members, pc, GridSpec(a=2.0, e=-1.0, width=GRID.width))
        assert sorted(map(tuple, found.collect())) == sorted(set(pairs))
    assert given[0].count() < len(pairs) / 4, len(pairs)


def test_box_join(spark):
    rng = np.random.default_rng(3)
    low = rng.uniform(-300, 300, (400, 2)).round(1)
    size = (rng.choice([0.0, 0.3, 2.0, 40.0], (400, 2)) * rng.uniform(0.5, 1, (400, 2))).round(1)
    size[7] = (90_000, 5)
    size[8] = size[9] = (0, 0)
    low[9] = low[8]
    boxes = [(i, float(x), float(y), float(x + w), float(y + h)) for i, ((x, y), (w, h)) in enumerate(zip(low, size, strict=True))]
    boxes += [(400, -1.0, -2.0, 0.0, 0.0), (401, 0.0, 0.0, 1024.0, 3.0)]  # a corner in common
    table = spark.createDataFrame(boxes, "id long, xmin double, ymin double, xmax double, ymax double")
    half = table.where("id % 3 = 0")
    meet = lambda a, b: a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]
    assert rows(adjacency.bbox_join(table, table), "one_id", "other_id") == sorted((a[0], b[0]) for a in boxes for b in boxes if meet(a, b))
    assert rows(adjacency.bbox_join(half, table), "one_id", "other_id") == sorted((a[0], b[0]) for a in boxes if a[0] % 3 == 0 for b in boxes if meet(a, b))
    assert adjacency.bbox_join(table.limit(0), table).count() == 0 and adjacency.bbox_join(table, table.limit(0)).count() == 0


def test_one_huge_box_costs_the_others_nothing(spark):
    x = F.col("id") % 300 * 3.0
    y = F.floor(F.col("id") / 300) * 3.0
    small = spark.range(60_000).select("id", x.alias("xmin"), y.alias("ymin"), (x + 1).alias("xmax"), (y + 1).alias("ymax"))
    huge = spark.createDataFrame([(-1, -5_000.0, -5_000.0, 5_000.0, 5_000.0)], small.schema)
    began = time.time()
    assert adjacency.bbox_join(small.unionByName(huge), small).count() == 120_000
    assert time.time() - began < 60


def test_triangles_around_a_hub(spark):
    rng = np.random.default_rng(5)
    extra = {(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(1, 400, (3000, 2)) if a != b}
    star = spark.range(1, 100_001).select(F.lit(0).alias("t"), F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    edges = star.unionByName(spark.createDataFrame([(0, a, b) for a, b in extra], "t int, src long, dst long"))
    beside = {}
    for a, b in extra:
        beside.setdefault(a, set()).add(b)
        beside.setdefault(b, set()).add(a)
    inner = sum(len(beside[a] & beside[b]) for a, b in extra)  # each inner triangle thrice
    began = time.time()
    found = {r.patch_id: r.n for r in adjacency.triangle_corners(edges).groupBy("patch_id").agg(F.count("*").alias("n")).collect()}
    assert found[0] == len(extra) and sum(found.values()) == 3 * len(extra) + inner and time.time() - began < 60


def test_numbers_and_row_slices(spark):
    table = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(3)).cast("string").alias("t"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(700)).alias("patch_id"), "id").repartition(7)
    got = edits.dense_ids(table).collect()
    for t in "012":
        mine = sorted((r.node_index, r.patch_id) for r in got if r.t == t)
        assert [i for i, _ in mine] == list(range(len(mine))) and [p for _, p in mine] == sorted(p for _, p in mine)
    whole = edits.numbered(table, [], ["patch_id", "id"], "n").collect()
    assert [r.n for r in sorted(whole, key=lambda r: (r.patch_id, r.id))] == list(range(5000))
    assert edits.dense_ids(table.limit(0)).count() == 0


def test_contraction_equals_recomputation(spark):
    grid = GridSpec(a=2.0, e=-3.0, width=100)
    pc = labelled(spark, drawn(5, 20, 25, 0.9, "abcd"), drawn(6, 9, 9, 1.0, "abc"))
    table, edges = edits.merge_classes_of_graph(patches.patch_table(pc, grid), adjacency.bordered_edges(pc, grid), ["a", "c"], "x")
    cells, plain = edits.merge_classes(pc, ["a", "c"], "x")
    names = ["t", "patch_id", "class_label", "n_cells", "area", "perimeter", "xmin", "ymin", "xmax", "ymax"]
    assert rows(table, *names) == rows(patches.patch_table(cells, grid), *names)
    assert rows(edges, "t", "src", "dst", "border") == rows(adjacency.bordered_edges(cells, grid), "t", "src", "dst", "border") and rows(edges, "t", "src", "dst") == rows(plain, "t", "src", "dst")
    with pytest.raises(ValueError):
        edits.merge_classes_of_graph(patches.patch_table(pc, grid), edges, ["q"], "x")


def test_mergeable_aggregates(spark):
    table = spark.range(20_000).select(F.when(F.col("id") < 19_000, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 5)).alias("class_label"), F.lit(1).alias("t"), (F.col("id") % 977).cast("double").alias("area"), F.when(F.col("id") % 3 > 0, F.col("id") * 0.5).alias("perimeter")).repartition(5)
    table = table.unionByName(spark.createDataFrame([("empty", 1, None, None)], "class_label string, t int, area double, perimeter double"))
    spread = metrics.Mergeable(lambda x: [x.min(), x.max()], lambda s: [s[:, 0].min(), s[:, 1].max()], lambda s: s[1] - s[0])
    want = table.groupBy("t", "class_label").agg(*[(F.max(c) - F.min(c)).alias(c) for c in ("area", "perimeter")])
    assert rows(metrics.mergeable_aggregates(table, spread).na.fill(-1), "class_label", "area", "perimeter") == rows(want.na.fill(-1), "class_label", "area", "perimeter")


def test_stores_keep_types_and_the_version_before(spark, tmp_path):
    cells = spark.createDataFrame([("01", 0, 0, "a"), ("02", 0, 0, "a"), ("02", 0, 1, "b")], "t string, row long, col long, class_label string")
    land = Landscape(cells, GRID)
    path = str(tmp_path / "land")
    land.save(path)
    first = Landscape.load(spark, path)
    assert rows(first.cells, "t", "col") == [("01", 0), ("02", 0), ("02", 1)] and first.grid == GRID
    for _ in range(3):
        Landscape.load(spark, path).save(path, overwrite=True)
    assert rows(tables.read_landscape(spark, path).cells, "t", "col") == rows(land.cells, "t", "col")
    assert len(list((tmp_path / "land").glob("v*"))) == tables.KEPT_VERSIONS
    broken = land.cells.withColumn("col", F.when(F.col("t") == "02", F.raise_error(F.lit("no more"))).otherwise(F.col("col")).cast("long"))
    with pytest.raises(Exception, match="no more"):
        tables.write_landscape(path, broken, land.patches, land.edges, overwrite=True, grid=GRID)
    assert rows(tables.read_landscape(spark, path).cells, "t", "col") == rows(land.cells, "t", "col")
    h = land.add_habitat("h", ["a"], barrier_classes=["b"], max_travel_distance=1.0, add_distance=True)
    place = str(tmp_path / "habitat")
    tables.write_habitat(place, h)
    with pytest.raises(FileExistsError):
        tables.write_habitat(place, h)
    tables.write_habitat(place, tables.read_habitat(spark, place), overwrite=True)
    again = tables.read_habitat(spark, place)
    assert rows(again.nodes, "t", "patch_id", "area") == rows(h.nodes, "t", "patch_id", "area") and (again.name, again.barrier_classes, again.max_travel_distance, again.add_distance) == ("h", ["b"], 1.0, True)
    with pytest.raises(FileNotFoundError):
        tables.read_landscape(spark, str(tmp_path / "nothing"))


def test_overlap_of_polygons_of_20000_sides(spark):
    n = 20_000
    ring = lambda x, r, k=n: [(x + r * math.cos(2 * math.pi * i / k), r * math.sin(2 * math.pi * i / k)) for i in range(k)]
    table = polygons(spark, [[ring(0.0, 100.0)]], [[ring(70.0, 100.0), ring(70.0, 40.0, 4000)]])
    began = time.time()
    row = vector.relations(table).first()
    took = time.time() - began
    lens = 2 * 100**2 * math.acos(35 / 100) - 35 * math.sqrt(4 * 100**2 - 70**2)
    # of the hole only what lies in the first circle is missing from the lens
    d, a, b = 70.0, 100.0, 40.0
    hole = b * b * math.acos((d * d + b * b - a * a) / (2 * d * b)) + a * a * math.acos((d * d + a * a - b * b) / (2 * d * a)) - 0.5 * math.sqrt((-d + b + a) * (d + b - a) * (d - b + a) * (d + b + a))
    assert row.contact == "interior" and row.overlap == pytest.approx(lens - hole, rel=1e-5) and took < 60


@pytest.mark.parametrize("tolerance", [0.0, 1.5])
def test_polygons_of_many_sides_side_by_side(spark, monkeypatch, tolerance):
    """Whichever way the sides come together, relations are the same."""
    rng = random.Random(4)

    def star(x, y, r, n):
        return [(x + (r * (0.6 + 0.4 * rng.random())) * math.cos(2 * math.pi * i / n), y + r * math.sin(2 * math.pi * i / n)) for i in range(n)]

    shapes = [[[star(0, 0, 50, 120), star(0, 0, 10, 15)]], *[[[star(rng.uniform(-60, 60), rng.uniform(-60, 60), rng.uniform(1, 9), 8)]] for _ in range(40)]]
    table = polygons(spark, *shapes)
    found = []
    for most in (256, 20, 1):
        monkeypatch.setattr(vector, "MANY_SIDES", most)
        found.append(sorted((r.one_id, r.other_id, round(r.distance, 9), r.contact, round(r.overlap, 7)) for r in vector.relations(table, None, tolerance).collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) > 20


def test_pyramid_levels(spark):
    tree = pyramid.Pyramid(spark.createDataFrame([(0, 1, 0, 0), (0, 1, 0, 1), (0, 1, 20, 5)], "t long, c long, row long, col long"))
    assert tree.top == 3
    assert rows(tree.level(1, "a", "src"), "a_br", "a_bc", "a_n", "a_first", "a_last") == [(0, 0, 2, 0, 1), (5, 1, 1, 5, 5)]
    assert rows(tree.level(3, "a", "src", parents=False), "a_n", "a_r1", "a_k1") == [(3, 20, 5)]
