"""Stages of the pipeline over tables with columns of clashing names, and settings of batches in any unit."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tidemark.llm import common, langid, licenses

NAMES = ("_at", "_bits", "_own0", "_own1", "_bucket", "_row", "_gone", "once", "score_", "least_", "lang_pred_", "digest", "n", "own", "node", "rep", "group", "size", "component_id", "text_key")


def rows():
    r = random.Random(3)
    words = {"aa": ["the", "ing", "tion"], "bb": ["cion", "ado", "que"]}
    out = []
    for i in range(60):
        lang = r.choice(list(words))
        out.append((i, " ".join("".join(r.choice(words[lang]) for _ in range(r.randint(1, 4))) for _ in range(90)), lang))
    return out + [(100 + i, out[i][1], None) for i in range(8)] + [(3, out[3][1], "aa"), (None, None, None)]


def test_clashing_names(spark, tmp_path):
    plain = spark.createDataFrame(rows(), "doc_id long, text string, lang string")
    clash = plain.select("*", *(F.lit(k).alias(n) for k, n in enumerate(NAMES)))
    spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(60)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        want, got = stage(spark, plain, str(tmp_path)), stage(spark, clash, str(tmp_path))
        assert got.columns == clash.columns, name
        kept = got.collect()
        assert sorted(map(str, ((r["doc_id"], r["text"], r["lang"]) for r in kept))) == sorted(str(tuple(r)) for r in want.collect()), name
        assert all(r[n] == k for r in kept for k, n in enumerate(NAMES)), name
    packed = corpus_pipeline.STAGES[-1][1](spark, clash.where("doc_id < 9"), str(tmp_path))
    assert packed.count() >= 9


@pytest.mark.parametrize("asked", ["1g", "64M", "512k", "3000000", "1024b"])
def test_batch_settings_of_any_unit(spark, asked):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, asked)
        df = spark.createDataFrame([(1, "MIT license " * 3)], "doc_id long, text string")
        assert licenses.scan_licenses(df).first().n_base == 3
        assert spark.conf.get(name) == (asked if asked in ("512k", "1024b") else f"{common.ARROW_BYTES}b")
    finally:
        spark.conf.set(name, before)


def test_unused_names(spark):
    df = spark.createDataFrame([(1, 2)], "Score_ int, score__ int")
    assert common.unused(df, "score_") == "score___" and common.unused(df, "x") == "x"
    assert langid.judged(spark.createDataFrame([(1, "a", 2.0)], "doc_id long, text string, score_ double"), iter([]))[2] == "score__"
