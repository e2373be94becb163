"""The pipeline's stages on one small corpus, against what they promise."""

from __future__ import annotations

import random
from collections import Counter

import pytest

import corpus_pipeline as pipeline
from authscope.llm import queries


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder, rng = tmp_path_factory.mktemp("corpus"), random.Random(1)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(n))
    rows = [(i, text(rng.randint(60, 200)), "en", f"src{i % 4}") for i in range(300)]
    rows += [(1000 + i, rows[i][1], "en", "src9") for i in range(50)]  # copies
    rows += [(2000, text(5), "en", "src0"), (2001, "again and again " * 40, "en", "src0"), (2002, None, None, None)]
    rows += [(3000, text(70) + " token = 9f8e7d6c5b4a39281706f5e4 " + text(70), "en", "src1")]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, corpus).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns
    ids = {name: Counter(r["doc_id"] for r in d.select("doc_id").collect()) for name, d in seen.items()}
    assert set(ids["quality rules"]) == {*range(300), *range(1000, 1050), 3000}
    assert set(ids["near dedup"]) == {*range(300), 3000} and set(ids["near dedup"].values()) == {1}
    assert ids["secret scan"] == ids["near dedup"]
    redacted = seen["secret scan"].filter("doc_id = 3000").first()["text"]
    assert "token = [SECRET] " in redacted and "9f8e7d6c" not in redacted
    assert set(ids["mixing"].values()) <= {1, 2}
    assert set(ids["packing"]) == set(ids["mixing"])
    assert pipeline.run(spark, corpus).count() == seen["packing"].count()


def test_queries_are_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
