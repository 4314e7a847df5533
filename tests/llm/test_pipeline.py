"""The pipeline stage by stage on a small corpus."""

import random

import corpus_pipeline
from landmosaic.llm import queries
from tests.llm.test_texts import brute_components, brute_repeats, words


def write(spark, path, rows, labels):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def corpus():
    rng = random.Random(12)
    shared = words(rng, 70)
    texts = [words(rng, 120) + " " + (shared if i % 9 == 0 else words(rng, 70)) for i in range(240)]
    texts += [texts[i] + " tail" for i in range(30)] + ["SPAM!! SPAM!! " * 15] * 60 + [None, ""]
    labels = [(i, int("SPAM" not in (t or "SPAM")), 0) for i, t in enumerate(texts) if t]
    return [(i, t, "en", f"s{i % 3}", len(t) if t else 0) for i, t in enumerate(texts)], labels


def test_stages(spark, tmp_path):
    rows, labels = corpus()
    write(spark, str(tmp_path), rows, labels)
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    text = {r[0]: r[1] for r in rows}

    good = stage["quality_classifier"](spark, table, str(tmp_path))
    ids = sorted(r.doc_id for r in good.collect())
    assert good.columns == table.columns and set(range(270)) <= set(ids) and not {i for i in ids if text[i] and "SPAM" in text[i]}

    clean = table.where("doc_id < 270")
    kept = sorted(r.doc_id for r in stage["near_duplicates"](spark, clean, str(tmp_path)).collect())
    assert kept == [i for i, (_, c) in enumerate(brute_components([text[i] for i in range(270)], 5, 80)) if c == i]

    single = table.where("doc_id < 240")
    cut = {r.doc_id: r for r in stage["repeated_passages"](spark, single, str(tmp_path)).collect()}
    for i, (n_bytes, removed, _, _) in enumerate(brute_repeats([text[i] for i in range(240)], 200)):
        assert len(cut[i].text.encode()) == n_bytes - removed and cut[i].n_chars == len(cut[i].text)

    mixed = stage["source_mixing"](spark, single, str(tmp_path))
    copies = {}
    for r in mixed.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
        assert r.text == text[r.doc_id]
    assert mixed.columns == table.columns and max(copies.values()) <= 2 and sum(copies.values()) >= 1.3 * 240

    encoded = stage["piece_encoding"](spark, single, str(tmp_path)).collect()
    assert len(encoded) == 240 and all(r.round_trip and r.n_pieces > 0 for r in encoded)


def test_whole_run_and_empty_tables(spark, tmp_path):
    rows, labels = corpus()
    write(spark, f"{tmp_path}/a", rows[::3], labels)
    out = queries.QUERIES["pipeline"](spark, f"{tmp_path}/a")
    assert out.count() > 60 and out.where("not round_trip").count() == 0
    write(spark, f"{tmp_path}/b", [], [])
    assert queries.QUERIES["pipeline"](spark, f"{tmp_path}/b").count() == 0


def test_stages_keep_rows_without_ids_and_columns_of_any_name(spark):
    rng = random.Random(4)
    a, b, c = (words(rng, 90) for _ in range(3))
    rows = [(None, a), (None, b), (3, c), (3, b + " end"), (3, c), (None, None), (9, "")]
    names = ["row_key", "times", "key", "doc", "ranges", "score", "name", "quality_score"]
    table = spark.createDataFrame([(i, t, "en", "s", None, *["x"] * len(names)) for i, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {', '.join(n + ' string' for n in names)}")
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["near_duplicates"](spark, table, "")
    assert kept.columns == table.columns
    # the near copy of b with an id goes before the one without; the repeated row counts once
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(0, a), (3, b + " end"), (3, c), (0, ""), (9, "")])
    cut = stage["repeated_passages"](spark, table, "")
    assert cut.columns == table.columns and cut.count() == len(rows)
    mixed = stage["source_mixing"](spark, table, "")
    assert mixed.columns == table.columns and {r.text or "" for r in mixed.collect()} >= {a, b, c, ""}


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)] + ["pipeline"]
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality_classifier" and corpus_pipeline.ORACLE_SQL is None
