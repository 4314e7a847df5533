"""Vector searches against brute force."""

import math

import numpy as np
import pytest

from landmosaic.llm import hash_forest, pivot_search

SCHEMA = "vec_id long, embedding array<double>, score string, rank string, id string, v string, query_id string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x", "x", "x", "x", "x") for i, v in rows], SCHEMA).repartition(3)


def odd_rows():
    return [(20, None), (40, [1.0, None, 0.0]), (60, [math.nan, 0.0, 0.0]), (80, [math.inf, 0.0, 0.0]), (100, [])]


def brute(rows, every, k):
    out = {}
    for q, v in rows:
        if q % every == 0:
            scored = sorted((-float(np.dot(v, w)), i) for i, w in rows if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def results(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("block", [37, 4096])
def test_pivot_search_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr(pivot_search, "ROW_BLOCK", block)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=12) * rng.choice([0.1, 1, 3])) for i in range(101, 600)]
    rows += [(i, rows[0][1]) for i in range(600, 640)]  # ties
    got = results(pivot_search.top_k(table(spark, rows + odd_rows())))
    scaled = [(i, np.floor(64 * v)) for i, v in rows]
    assert got == brute(scaled, 20, 20)


def test_pivot_search_few_huge_and_none(spark):
    assert results(pivot_search.top_k(table(spark, [(20, [1.0, 2.0]), (21, [0.5, 0.0])]))) == {20: [(21, 64 * 32)]}
    big = [(20, [3e7, 1.0]), (21, [2e7, 5.0]), (22, [2e7, 4.0])]
    got = results(pivot_search.top_k(table(spark, big)))
    assert [i for i, _ in got[20]] == [21, 22] and got[20][0][1] == (64 * 30_000_000) * (64 * 20_000_000) + 64 * 320
    assert pivot_search.top_k(table(spark, odd_rows())).count() == 0 and pivot_search.top_k(table(spark, [])).count() == 0


def test_forest_recall_and_scores(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v / np.linalg.norm(v)) for i, v in enumerate(rng.normal(size=(3000, 32)))]
    got = results(hash_forest.neighbours(table(spark, rows + [(5000, np.zeros(32))] + [(i + 10_000, v) for i, v in odd_rows()])))
    truth = brute(rows, 20, 20)
    assert set(got) == set(truth)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in truth[q]}) / 20 for q in truth]) >= 0.9
    vectors = dict(rows)
    assert all(s == pytest.approx(float(np.dot(vectors[q], vectors[i])), abs=1e-12) for q, found in got.items() for i, s in found)


def test_forest_few_rows_and_ties(spark):
    got = results(hash_forest.neighbours(table(spark, [(0, [1.0, 0.0]), (3, [0.5, 0.0]), (2, [0.5, 0.0]), (4, [-1.0, 0.0])])))
    assert got == {0: [(2, 0.5), (3, 0.5), (4, -1.0)]}


def test_searches_of_repeated_ids_empty_tables_and_huge_values(spark):
    for search in (pivot_search.top_k, hash_forest.neighbours):
        twice = results(search(table(spark, [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [0.5, 9.0]), (21, [2.0, 0.0]), (21, [2.0, 0.0]), (22, [1.0, 0.0]), (None, [5.0, 5.0])])))
        assert [i for i, _ in twice[20]] == [21, 22] and len(twice) == 1
        assert search(table(spark, [])).count() == 0
    big = [(20, [1e12, 1.0]), (21, [1e12, 2.0]), (22, [-1e12, 0.0]), (23, [1e200, 0.0])]
    got = results(pivot_search.top_k(table(spark, big)))[20]
    assert [i for i, _ in got] == [21, 23, 22] and [s for _, s in got] == [2**63 - 1, 2**63 - 1, -(2**63)]


def test_pivots_eliminate_where_vectors_lie_together():
    rng = np.random.default_rng(7)
    centres = rng.integers(-900, 900, (40, 24))
    rows = (centres[rng.integers(0, 40, 4000)] + rng.integers(-9, 10, (4000, 24))).astype(float)
    rows *= 1000 / np.sqrt((rows**2).sum(axis=1, keepdims=True))
    rows = np.floor(rows)
    ids, asked, tally = np.arange(4000), np.arange(0, 4000, 20), []
    q, found, score = pivot_search.pivot_kernel(ids, rows, asked, rows[asked], 20, tally)
    for i in asked[::10]:
        want = sorted((-float(rows[i] @ rows[j]), j) for j in ids if j != i)[:20]
        assert [(-s, j) for s, j in want] == [(float(s), int(j)) for s, j in zip(score[q == i], found[q == i], strict=True)]
    assert np.mean(tally) < 0.2 * 4000


def test_equal_vectors_score_the_same_in_any_block(spark, monkeypatch):
    rng = np.random.default_rng(11)
    copy = rng.normal(size=64)
    rows = [(i, copy if i % 7 == 0 else v) for i, v in enumerate(rng.normal(size=(700, 64)))]
    monkeypatch.setattr(hash_forest, "ROW_BLOCK", 90)
    got = results(hash_forest.neighbours(table(spark, rows)))
    for q in (0, 140, 280):
        assert [i for i, _ in got[q]] == [i for i in range(0, 700, 7) if i != q][:20] and len({s for _, s in got[q]}) == 1


def test_forest_recall_on_supplied_vectors(spark):
    import pyarrow.parquet as pq

    found = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pylist()
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in found]
    got = results(hash_forest.neighbours(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")))
    truth = brute(rows, 20, 20)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in truth[q]}) / 20 for q in truth]) >= 0.9
