"""The pipeline's stages by themselves and as a whole: no clean text is lost, and odd rows and empty tables pass."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tollgate.llm import components, near_text

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def letters(seed, n=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def test_near_duplicates_drops_rows_and_not_ids(spark, folder):
    one, two, three = letters(1), letters(2), letters(3)
    rows = [(1, one, "a"), (1, two, "a"), (2, two, "b"), (3, three, "a"), (3, three, "b"), (4, three + " end", "a"), (None, one, "a"),
            (None, letters(9), "a"), (5, None, "a"), (6, None, "a"), (6, None, "b"), (7, "", "a"), (8, "", "a")]
    got = corpus_pipeline.drop_near_duplicates(spark, make(spark, rows), folder)
    kept = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str)
    assert kept == sorted([(1, one), (1, two), (3, three), (None, letters(9)), (5, None), (6, None), (7, ""), (8, "")], key=str)
    assert got.columns == corpus_pipeline.COLUMNS


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_no_rows(spark, folder, name, stage):
    assert stage(spark, make(spark, []), folder).count() == 0


def test_pipeline_on_odd_rows(spark, folder, tmp_path):
    given = spark.read.parquet(f"{folder}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    odd = make(spark, [(10_001, None, None), (10_002, "", "web"), (None, letters(4), "web"), (10_003, letters(5) * 300, None)])
    given.unionByName(odd).unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and all(r["n_tokens"] == len(r["ids"]) for r in rows)
    assert len({(r["doc_id"], r["decoded_sha256"]) for r in rows}) <= given.count() + 3


def families(n, size, seed=3):
    """Documents of which each shares half of its words with its family's base, so that they meet under keys and link with none."""
    r = np.random.default_rng(seed)
    rows, words = [], np.array([f"w{i}" for i in range(20_000)])
    for family in range(n // size):
        base = r.integers(0, 20_000, 80)
        for k in range(size):
            own = np.append(base[:44], r.integers(0, 20_000, 36))
            rows.append((family * size + k, " ".join(words[own])))
    return rows


def test_compared_texts_grow_with_the_table(spark, monkeypatch):
    """Families of documents that are like, but no copies: texts that are sent to be compared are in proportion to the documents."""
    seen, sent = {}, []
    real = near_text._mixed

    def spy(placed):
        out = real(placed)
        if "text" in placed.columns:
            sent.append(out.count())
        return out

    monkeypatch.setattr(near_text, "_mixed", spy)
    for n in (1_000, 10_000):
        found = near_text.near_duplicates(spark.createDataFrame(families(n, 5), "doc_id long, text string"))
        assert found.where("not kept").count() == 0
        seen[n] = sent.pop()
    assert seen[1_000] < 2_000
    assert seen[10_000] <= 13 * max(seen[1_000], 10)


def test_few_links_take_few_tasks(spark, monkeypatch):
    """Whatever the number of shuffle partitions, a round on few pairs leaves them in few files; more pairs give the same components."""
    written, real = [], components.materialize

    def spy(df, name):
        out = real(df, name)
        written.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(components, "materialize", spy)
    links = [(i, i + 1) for i in range(200)] + [(500 + 7 * i % 100, 500 + 31 * i % 100) for i in range(60)] + [(3, 2), (9, 9), (None, 1)]
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        few = sorted(components.components(spark.createDataFrame(links, "a long, b long")).collect())
        assert len(written) > 2 and max(written[1:]) <= components.FEW
        monkeypatch.setattr(components, "SENT", 0)
        assert sorted(components.components(spark.createDataFrame(links, "a long, b long")).collect()) == few
        assert all(r["component"] == 0 for r in few if r["node"] <= 200)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
