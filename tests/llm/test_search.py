"""Whitening, ranked search and decontamination against brute force."""

import hashlib
import math
import re

import duckdb
import numpy as np
import pytest

from landmosaic.llm import decontamination, term_stages, whitening

DOCS = "doc_id long, text string, key string, terms string, item string, n long, score string"


def documents(spark, rows, schema=DOCS):
    """Rows of id and text, beside columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "k", "t", "i", 5, "s") for i, t in rows], schema).repartition(3)


def items(spark, rows):
    return documents(spark, rows, DOCS.replace("doc_id", "item_id").replace("item string", "doc string"))


# --- whitening -----------------------------------------------------------------------


def vectors(spark, rows):
    schema = "vec_id long, embedding array<double>, x string, v string, component string"
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "a", "b", "c") for i, v in rows], schema).repartition(4)


ODD = [(1, None), (2, [1.0, None]), (3, [math.nan, 0.0]), (4, [0.0, math.inf])]


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 12)) @ rng.normal(size=(12, 12)) + 3
    rows = [(i, v) for i, v in enumerate(base, 10)] + [(i, base[0]) for i in range(1000, 1300)] + [(None, base[1]), (10, base[2])]  # many copies of one vector
    got = whitening.whiten_embeddings(vectors(spark, rows + ODD)).toPandas()
    x = np.floor(256 * np.array([v for _, v in rows]))
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    spread = np.cov(fit.T, bias=True)
    e, q = np.linalg.eigh(spread)
    e, q = e[::-1][:4], q[:, ::-1][:, :4]
    assert len(got) == 4 * len(rows) and set(got["n"]) == {n} and got["identity_error"].max() < 1e-9
    assert got.groupby("component")["explained"].first().to_numpy() == pytest.approx(e / np.trace(spread), rel=1e-10)
    want = ((x - total / n) @ q) / np.sqrt(e)
    dev = [int(d) for d in ((n * x - total) ** 2).sum(axis=1)]
    for i in (0, 57, 399):
        mine = got[got.vec_id == rows[i][0]].sort_values("component")
        mine = mine[mine.deviation == dev[i]]
        assert np.abs(mine.whitened.to_numpy()[:4]) == pytest.approx(np.abs(want[i]), rel=1e-9)
    assert sorted(got[got.component == 1].deviation) == sorted(dev)
    signs = [np.sign(np.dot(got[got.component == k].sort_values("deviation").whitened, np.arange(len(rows)))) for k in (1, 2)]
    assert all(s != 0 for s in signs)


def test_whitening_of_odd_tables(spark):
    run = lambda rows: whitening.whiten_embeddings(vectors(spark, rows)).collect()
    assert run([]) == [] and run(ODD) == [] and run([(9, [])]) == []
    assert run([(9, [1.0, 2.0]), (8, [1.0, 2.0])]) == []  # one vector has no variance
    line = run([(9, [1.0, 2.0]), (8, [2.0, 2.0]), (8, [2.0])])  # shorter vectors end in zeros
    assert {r.component for r in line} == {1, 2} and {r.n for r in line} == {3}
    flat = run([(9, [1.0, 5.0]), (8, [2.0, 5.0])])
    assert {(r.component, r.n, r.deviation, round(r.explained, 9)) for r in flat} == {(1, 2, 256**2, 1.0)} and sorted(round(r.whitened, 9) for r in flat) == [-1.0, 1.0]
    huge = run([(9, [1e300, 0.0]), (8, [-1e300, 1.0]), (7, [0.0, 2.0])])
    assert sorted({r.deviation for r in huge}) == [1 + 768**2, 2**63 - 1] and max(r.identity_error for r in huge) < 1e-4
    assert whitening.unpacked(whitening.packed(np.array([[2**63 - 1, 0], [-(2**40), 3], [0, 0], [5, -7]])), 3).tolist() == [[2**63 - 1, 0, 0], [-(2**40), 3, 0], [0, 0, 0], [5, -7, 0]]


@pytest.mark.parametrize("kind", ["any", "repeated", "equal", "one", "split"])
@pytest.mark.parametrize("n", [1, 2, 3, 17, 60])
def test_eigenvectors(n, kind):
    rng = np.random.default_rng(n)
    q = np.linalg.qr(rng.normal(size=(n, n)))[0]
    values = {"any": rng.uniform(0, 9, n), "repeated": np.r_[np.full(min(n, 3), 5.0), np.linspace(1, 2, max(0, n - 3))], "equal": np.full(n, 3.0), "one": np.r_[7.0, np.zeros(n - 1)], "split": np.r_[np.full((n + 1) // 2, 1.0), np.full(n // 2, 1 + 1e-9)]}[kind]
    a = q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    k = min(4, n)
    found, axes = whitening.leading_axes(a, k)
    assert found == pytest.approx(np.sort(values)[::-1][:k], abs=1e-13 * max(1, values.max()) * n)
    assert np.abs(axes.T @ axes - np.eye(k)).max() < 1e-12 and np.abs(a @ axes - axes * found).max() < 1e-12 * max(1, values.max()) * n


# --- ranked search -----------------------------------------------------------------------


def ranked(docs, asked, k=20):
    words = lambda t: [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    rows = [(i, words(t)) for i, t in docs]
    n, length = sum(bool(w) for _, w in rows), sum(len(w) for _, w in rows)
    df = {}
    for _, w in rows:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in asked:
        scored = []
        for i, w in rows:
            m = 100 - 25 + (25 * len(w) * n) // length if length else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((10**9 * w.count(x)) // (1000 * w.count(x) + 12 * m)) for x in words(text) if x in w)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def corpus(n=260, seed=4):
    rng = np.random.default_rng(seed)
    names = [f"w{i}" for i in range(60)] + ["Straße", "ΔX", "naïve", "A-b", "x_y"]
    text = lambda k: " ".join(rng.choice(names, k, p=(p := 1 / np.arange(1, len(names) + 1)) / p.sum()))
    rows = [(i, text(rng.integers(1, 40))) for i in range(n)]
    rows += [(i, rows[3][1]) for i in range(1000, 1150)] + [(7, "w1 W2, w3"), (7, "w1 w2 w3"), (None, "w1 w2 w3"), (None, None), (8, ""), (9, "--")]
    return rows, [(i, text(8)) for i in range(12)] + [(3, "w1 w1 w59"), (None, "w2"), (40, None), (41, "unseen"), (42, "W0 w0 w0")]


@pytest.mark.parametrize("options", [{}, {"shard": 50, "bundle": 3}, {"vocabulary": 5}, {"shares": (0.0,)}, {"k": 3, "shard": 200}])
def test_ranked_search(spark, options):
    docs, asked = corpus()
    got = term_stages.search(documents(spark, docs), items(spark, asked), **options)
    assert sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == ranked(docs, asked, options.get("k", 20))


def test_ranked_search_of_odd_tables(spark):
    run = lambda docs, asked: term_stages.search(documents(spark, docs), items(spark, asked)).collect()
    assert run([], [(1, "a")]) == [] and run([(1, "a")], []) == [] and run([(1, None)], [(1, "a")]) == []
    long_text = "word " * 300_000 + "rare " + "other " * 300_000  # longer than a stretch
    docs = [(1, long_text), (2, "rare other"), (3, "x" * 3_000_000 + " rare"), (4, "nothing here")]
    got = [tuple(r) for r in run(docs, [(5, "rare word")])]
    assert sorted((i, r, d, s) for i, r, d, s in got) == sorted(ranked(docs, [(5, "rare word")]))


# --- decontamination -----------------------------------------------------------------------


def report(docs, asked, span=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    windows = {}
    for item, text in asked:
        w = words(text)
        size = min(span, len(w))
        for a in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[a : a + size]), set()).add(item)
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for a in range(len(w) - size + 1):
                if tuple(w[a : a + size]) in windows:
                    hit |= set(range(a, a + size))
                    found |= windows[tuple(w[a : a + size])]
        names = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def leaks():
    rng = np.random.default_rng(8)
    some = lambda k, m=400: " ".join(f"v{x}" for x in rng.integers(0, m, k))
    asked = [(i, some(int(rng.integers(12, 40)))) for i in range(9)] + [(20, "one two three"), (21, "Alpha"), (22, some(9)), (23, None), (24, "?!"), (None, "some secret words here")]
    shared = some(14)
    asked += [(i, f"{some(3)} {shared} {some(2)}") for i in range(30, 45)] + [(0, some(11))]  # one passage in many items
    w = [t.split() for _, t in asked[:9]]
    docs = [(1, " ".join(["x"] + w[0][2:12] + ["y"])), (2, " ".join(w[0][2:11] + ["y"])), (3, " ".join(w[1] + w[2])), (4, " ".join(w[3]).upper().replace(" ", ", ")), (5, "one-two\tthree, one two Four"), (6, "ALPHA alphas alpha"), (10, "one\x00two\x7fthree\u00a0four İ ſtraße 𝔘x"), (7, asked[11][1]), (8, "a secret: some secret words here"), (9, None), (9, ""), (None, shared)]
    docs += [(i, f"before {shared} after") for i in range(100, 160)] + [(i, some(200)) for i in range(200, 240)]
    docs += [(300, ("la " * 4000) + shared), (301, "la " * 50)]
    return docs, asked + [(50, "la " * 12)]


@pytest.mark.parametrize("few", [None, 0])
def test_decontamination(spark, monkeypatch, few):
    if few is not None:  # nothing is broadcast
        monkeypatch.setattr(decontamination, "FEW_PRINTS", few)
        monkeypatch.setattr(decontamination, "FEW_WINDOWS", few)
    docs, asked = leaks()
    got = decontamination.contamination(documents(spark, docs), items(spark, asked))
    assert sorted((tuple(r) for r in got.collect()), key=str) == report(docs, asked)


def test_decontaminated_spans_and_odd_tables(spark):
    shared = " ".join(f"q{i}" for i in range(20))
    docs = [(1, f"a b {shared} c " + " ".join(f"q{i}" for i in range(5, 16))), (2, "a b"), (3, None)]
    spans = decontamination.contaminated_spans(documents(spark, docs), items(spark, [(1, shared)]))
    assert sorted(tuple(r) for r in spans.collect()) == [(1, 2, 20), (1, 23, 11)]
    none = hashlib.sha256(b"").hexdigest()
    got = decontamination.contamination(documents(spark, docs), items(spark, []))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 34, 0, 0, none, False), (2, 2, 0, 0, none, False), (3, 0, 0, 0, none, False)]
    assert decontamination.contamination(documents(spark, []), items(spark, [(1, shared)])).count() == 0


def test_decontamination_runs_no_python(spark):
    plan = decontamination.contamination(documents(spark, [(1, "a")]), items(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("name", ["op12_term_stages", "op13_decontamination"])
def test_queries_match_sql(spark, name):
    from landmosaic.llm import queries

    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"create view {table} as select * from '/root/testdata/sf0.001/{table}.parquet'")
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()
    want = con.sql(queries.ORACLES[name]).df()[list(got.columns)]
    assert sorted(map(tuple, got.astype(str).to_numpy())) == sorted(map(tuple, want.astype(str).to_numpy()))
