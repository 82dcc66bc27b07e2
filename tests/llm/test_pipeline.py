"""The pipeline's stages one by one, each on what the one before kept."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from quorumlake.llm.common import materialise
from quorumlake.llm.mixing import TARGET, mix

from .test_llm import brute_components


@pytest.fixture(scope="module")
def results(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in P.STAGES:
        docs = out[name] = materialise(stage(spark, docs, sf_dir))
    return out


def test_columns_and_decisions(results):
    names = [n for n, _ in P.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_dedup", "mixing", "packing"]
    cols = results["documents"].columns
    assert all(results[n].columns == cols for n in names[:-1])
    ids = {n: [r.doc_id for r in results[n].select("doc_id").collect()] for n in ["documents", *names]}
    assert set(ids["quality_rules"]) < set(ids["documents"]) and sorted(ids["line_dedup"]) == sorted(ids["quality_rules"])
    want = brute_components([(r.doc_id, r.text) for r in results["line_dedup"].collect()])
    assert sorted(ids["near_dedup"]) == sorted({c for c in want.values()})
    assert sorted(ids["mixing"]) == sorted(ids["near_dedup"]) and set(ids["packing"]) == set(ids["mixing"])
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in results["mixing"].collect())
    assert results["packing"].agg(F.sum("n_tokens")).first()[0] == words


def test_run_gives_the_last_stage(spark, sf_dir, results):
    key = ["doc_id", "part", "n_tokens", "bucket", "batch", "slot"]
    rows = lambda df: sorted(map(tuple, df.select(*key).collect()), key=repr)
    assert rows(P.run(spark, sf_dir)) == rows(results["packing"])


def test_stages_take_odd_rows(spark, sf_dir):
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "x " * 40, "en", "a", 80), (2, "", "en", "a", 0), (3, "y z " * 9, "en", None, 36), (3, "y z " * 9, "en", None, 36)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        assert stage(spark, docs, sf_dir).count() >= 0
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_batches_follow_the_mixing_order(spark, sf_dir, results):
    """In each bucket, batches and slots rank the pieces by the mixing position of their documents."""
    order = {r.doc_id: r.position for r in mix(results["near_dedup"], TARGET).collect()}
    assert len(order) == results["near_dedup"].count()
    got = results["packing"].where("n_tokens > 0").toPandas().sort_values(["bucket", "batch", "slot"])
    for _, b in got.groupby("bucket"):
        places = [(order[i], p) for i, p in zip(b.doc_id, b.part)]
        assert places == sorted(places)
    without = P.packing_stage(spark, results["near_dedup"], sf_dir).toPandas().sort_values(["bucket", "batch", "slot"])
    assert list(without.doc_id) != list(got.doc_id)
