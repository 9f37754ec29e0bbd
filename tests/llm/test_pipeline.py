import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from sluice.llm import decontaminate, lines, simhash
from sluice.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and output, as ``run`` writes them."""
    kept, write = [table(spark, SF, "documents")], cp.materialise

    def noted(df, label):
        kept.append(write(df, label))
        return kept[-1]

    cp.materialise = noted
    try:
        kept.append(write(cp.run(spark, SF), "packing"))
    finally:
        cp.materialise = write
    return {name: (kept[k], kept[k + 1]) for k, (name, _) in enumerate(cp.STAGES)}


def test_order_and_columns(stages):
    assert list(stages) == ["quality", "lines", "near_duplicates", "decontamination", "packing"]
    for name in list(stages)[:-1]:
        before, after = stages[name]
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_each_stage_takes_effect_and_keeps_clean_documents(spark, stages):
    labels = table(spark, SF, "labels")
    before, after = stages["quality"]
    kept = {r.doc_id for r in after.collect()}
    good = [r.doc_id in kept for r in labels.where("quality = 1").collect()]
    bad = [r.doc_id in kept for r in labels.where("quality = 0").collect()]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.3
    before, after = stages["lines"]
    text = {r.doc_id: r.text for r in after.collect()}
    gone = {(r.doc_id, r.line) for r in lines.groups(before).where("not kept").collect()}
    assert gone
    for r in before.collect():
        want = [x for k, x in enumerate(r.text.split("\n")) if (r.doc_id, k) not in gone]
        assert text.get(r.doc_id, "\n".join(want) if not any(map(str.strip, want)) else None) == "\n".join(want)
    before, after = stages["near_duplicates"]
    assert simhash.near_duplicates(after).where("doc_id <> component_id").count() == 0
    assert after.count() < before.count()
    before, after = stages["decontamination"]
    assert decontaminate.report(after, table(spark, SF, "benchmark")).where("contaminated").count() == 0
    assert after.where(F.col("n_chars") != F.char_length("text")).count() == 0
    before, after = stages["packing"]
    assert {r.doc_id for r in after.select("doc_id").collect()} == {r.doc_id for r in before.select("doc_id").collect()}


def test_texts_go_to_workers_a_few_at_once(spark):
    import corpus_pipeline
    from sluice.llm import common

    docs = spark.createDataFrame([(k, f"{k} " + "word " * 40_000) for k in range(120)], "doc_id long, text string").coalesce(1)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(name)
    try:
        corpus_pipeline.unique_documents(spark, docs, "")
        size = lambda batches: (b.slice(0, 1).from_pydict({"n": [b.nbytes]}) for b in batches)
        assert max(r.n for r in docs.mapInArrow(size, "n long").collect()) < 1.2 * common.BATCH_BYTES
    finally:
        spark.conf.set(name, old)
