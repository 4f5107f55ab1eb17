from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from duskwire.llm import quality, toxicity  # noqa: F401
from tests.llm.test_bpe import digests
from tests.llm.test_decontam import expected as leaks
from tests.llm.test_decontam import pairs
from tests.llm.test_pii import spans
from tests.llm.test_similar import expected as near


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """What each stage returns, each from the one before."""
    out = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], sf_dir).persist())
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns(stages):
    assert all(x.columns == stages[0].columns for x in stages[1:-1])


def test_quality_keeps_good_documents_and_drops_junk(spark, sf_dir, stages):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    left = ids(stages[1])
    good = [r.doc_id in left for r in labels if r.quality == 1]
    bad = [r.doc_id in left for r in labels if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.4 * len(bad)


def test_one_of_each_near_group(stages):
    assert sorted((False, i) for i in ids(stages[2])) == near(pairs(stages[1], "doc_id", "text"))


def test_benchmark_items_are_gone(spark, sf_dir, stages):
    items = pairs(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", "text")
    bad = {d for d, *_ in leaks(pairs(stages[2], "doc_id", "text"), items)}
    assert bad and ids(stages[3]) == ids(stages[2]) - bad


def test_personal_data_is_gone(stages):
    before = {r.doc_id: r.text for r in stages[3].collect()}
    after = stages[4].collect()
    assert {r.doc_id for r in after} == before.keys()
    for r in after:
        assert r.n_chars == len(r.text)
        if not spans(before[r.doc_id]) and r.text != before[r.doc_id]:
            assert "[" in r.text
        for a, _, _, b in spans(before[r.doc_id]):
            assert before[r.doc_id][a:b] not in r.text or before[r.doc_id].count(before[r.doc_id][a:b]) > 1


def test_tokens(stages):
    from duskwire.llm import bpe
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_path())
    tok.no_truncation()
    tok.no_padding()
    assert sorted(map(tuple, stages[5].collect())) == sorted((r.doc_id, *digests(tok, r.text)) for r in stages[4].select("doc_id", "text").collect())


def test_run_is_its_stages(spark, sf_dir, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, stages[-1].collect()))


def test_odd_documents(spark, messy, tmp_path):
    d = str(tmp_path)
    messy.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 0, None), (7, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "sleepy dog and then runs back"), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in rows} >= {1, 7, 8, 9, 11, -12} and 3 not in {r.doc_id for r in rows}


def test_no_documents(spark, empty, tmp_path):
    d = str(tmp_path)
    empty.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).where(F.lit(True)).collect() == []
