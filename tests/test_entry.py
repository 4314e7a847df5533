"""The registered queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pytest

from landmosaic.plans import coverage, mosaic

SF = "/root/testdata/sf0.001"
FEW = ["class_metrics", "landscape_metrics", "patch_adjacency", "node_dynamics", "habitat_edges", "merge_nodes", "clip_to_region", "vector_overlap", "stored_landscape", "region_geojson", "cell_degrees", "component_unions", "landscape_habitat_edges", "own_metric", "component_distances", "barrier_habitat", "resampled", "reproject"]


assert coverage.QUERIES is mosaic.QUERIES  # one register


def values(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple("null" if x is None or x != x else f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", FEW)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    assert values(mosaic.QUERIES[name](spark, SF).toPandas()) == values(con.sql(mosaic.ORACLES[name]).df())


@pytest.fixture(scope="module")
def tall(spark, tmp_path_factory):
    """Tables of a landscape of 52 rows, and its habitat cells by slice and patch."""
    folder = str(tmp_path_factory.mktemp("tall"))
    orders = spark.range(52 * 150).where("id % 150 < 7 or id % 150 between 138 and 144")
    orders.selectExpr("id as o_orderkey", "date_add(date'1993-01-01', cast(pmod(xxhash64(id), 3000) as int)) as o_orderdate").write.parquet(f"{folder}/orders.parquet")
    spark.read.parquet(f"{SF}/part.parquet").selectExpr("p_partkey", "case when p_partkey % 3 = 0 then 'SMALL' else p_type end as p_type").write.parquet(f"{folder}/part.parquet")
    grid = {(r.t, r.row, r.col): r.class_label for r in mosaic.cells(spark, folder).collect()}
    good, seen = {}, set()
    for cell in sorted(grid):
        if cell in seen or grid[cell] not in mosaic.VALID:
            continue
        patch, todo = [], [cell]
        seen.add(cell)
        while todo:
            t, r, c = todo.pop()
            patch.append((r, c))
            for x in ((t, r + 1, c), (t, r - 1, c), (t, r, c + 1), (t, r, c - 1)):
                if x not in seen and grid.get(x) == grid[cell]:
                    seen.add(x)
                    todo.append(x)
        good[cell[0], cell[1] * 150 + cell[2]] = np.array(patch)
    return folder, good


def gap(one, other):
    d = np.maximum(np.abs(one[:, None, :] - other[None, :, :]) - 1, 0) * 30.0
    return float(np.sqrt((d**2).sum(axis=2)).min())


def test_habitats_cover_the_whole_landscape(spark, tall):
    folder, good = tall
    run = lambda name, *cols: sorted(tuple(r) for r in mosaic.QUERIES[name](spark, folder).select(*cols).collect())
    assert {t for t, _ in good} == set(mosaic.TIMES) and max(r for p in good.values() for r, _ in p) > 45 and max(c for p in good.values() for _, c in p) > 140
    between = {(t, a, b): round(gap(good[t, a], good[t, b]), 6) for t, a in good for s, b in good if s == t and a < b}
    links = {k: d for k, d in between.items() if d <= 60}
    assert run("landscape_habitat_edges", "t", "src", "dst", "distance") == sorted((*k, d) for k, d in links.items())
    assert run("landscape_habitat_touching", "t", "src", "dst") == sorted(k for k, d in links.items() if d == 0)
    comp = {k: k[1] for k in good}
    changed = True
    while changed:
        changed = False
        for t, a, b in links:
            least = min(comp[t, a], comp[t, b])
            changed |= comp[t, a] != least or comp[t, b] != least
            comp[t, a] = comp[t, b] = least
    assert run("landscape_habitat_components", "t", "component_id", "patch_id") == sorted((t, c, p) for (t, p), c in comp.items())
    apart = {}
    for (t, a, b), d in between.items():
        x, y = sorted((comp[t, a], comp[t, b]))
        if x != y:
            apart[t, x, y] = min(d, apart.get((t, x, y), d))
    assert run("landscape_component_distances", "t", "src", "dst", "distance") == sorted((*k, d) for k, d in apart.items())
    near = {}
    for (t, a, b), d in apart.items():
        for c in (a, b):
            near[t, c] = min(d, near.get((t, c), d))
    mean = {t: np.mean([d for (s, _), d in near.items() if s == t]) for t in {t for t, _ in near}}
    assert dict(run("landscape_component_nearest", "t", "mean_nearest_component_distance")) == pytest.approx(mean, abs=1e-5)
    assert dict(run("landscape_habitat_metrics", "t", "num_components")) == {t: len({c for (s, _), c in comp.items() if s == t}) for t in mosaic.TIMES}
    steps = [(r, c) for r in range(-2, 3) for c in range(-2, 3) if max(abs(r) - 1, 0) ** 2 + max(abs(c) - 1, 0) ** 2 <= 1]
    assert run("landscape_habitat_reach", "t", "patch_id", "row", "col") == sorted({(t, p, int(y) + r, int(x) + c) for (t, p), cells in good.items() for y, x in cells for r, c in steps})
    assert {r.t for r in mosaic.QUERIES["barrier_habitat"](spark, folder).collect()} == set(mosaic.TIMES)


def test_resampling_covers_the_whole_landscape(spark, tall):
    folder, _ = tall
    con = duckdb.connect()
    for name in ("orders", "part"):
        con.sql(f"create view {name} as select * from '{folder}/{name}.parquet/*.parquet'")
    got = mosaic.QUERIES["landscape_resampled"](spark, folder).toPandas()
    assert values(got) == values(con.sql(mosaic.ORACLES["landscape_resampled"]).df())
    grid = {(r.t, r.row, r.col): r.class_label for r in mosaic.cells(spark, folder).collect()}
    want = {(t, i, j): grid[t, (8 * i + 4) // 6, (8 * j + 4) // 6] for t in mosaic.TIMES for i in range(39) for j in range(112) if (t, (8 * i + 4) // 6, (8 * j + 4) // 6) in grid}
    assert {(t, r, c): k for t, r, c, k in got[["t", "row", "col", "class_label"]].itertuples(index=False)} == want and max(r for _, r, _ in want) == 38


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[:2] == ["t", "class_label"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
