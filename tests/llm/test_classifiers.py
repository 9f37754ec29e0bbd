import numpy as np
from pyspark.sql import functions as F

from sluice.llm import quality, text, toxicity

SF = "/root/testdata/sf0.1"


def test_ordinal_fit_recovers_order_and_matches_numeric_gradient():
    rng = np.random.default_rng(1)
    rows = [(np.arange(3), rng.normal(size=3)) for _ in range(1500)]
    x = toxicity.Rows(rows, 3)
    w = np.array([2.0, -1.0, 0.0])
    noise = rng.logistic(size=1500)
    grade = np.searchsorted([-1.0, 0.5, 2.0], x.times(w) + noise)
    got, thresholds = toxicity.fit_ordinal(x, grade, 3, ridge=0, steps=600)
    assert np.all(np.diff(thresholds) > 0)
    assert np.allclose(got, w, atol=0.3) and np.allclose(thresholds, [-1, 0.5, 2], atol=0.3)


def test_toxicity_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    even = F.xxhash64("doc_id") % 2 == 0
    model = toxicity.fit(docs, labels.where(even))
    got = toxicity.score(docs, model).withColumnRenamed("toxic", "said").join(labels.where(~even), "doc_id")
    rows = got.select("said", "toxic", "expected_severity").collect()
    caught = [r.said for r in rows if r.toxic == 1]
    false = [r.said for r in rows if r.toxic == 0]
    assert np.mean(caught) > 0.8 and np.mean(false) < 0.01  # the rest are garbled texts and rare stems of this small sample


def test_quality_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    even = F.xxhash64("doc_id") % 2 == 0
    model = quality.fit(docs, labels.where(even))
    rows = quality.score(docs, model).join(labels.where(~even).withColumnRenamed("quality", "y"), "doc_id").select("keep", "y").collect()
    assert np.mean([r.keep for r in rows if r.y == 1]) > 0.99
    assert np.mean([r.keep for r in rows if r.y == 0]) < 0.05
    kept = quality.keep_good(docs, model)
    assert kept.schema == docs.schema
    assert kept.count() == quality.score(docs, model).where("keep").count()


def test_co_training_exchanges_labels_and_helps_the_weak_view():
    rng = np.random.default_rng(3)
    truth = rng.integers(0, 2, 900)
    a = truth[:, None] * 3.0 + rng.normal(size=(900, 2))
    b = truth[:, None] * 2.0 + rng.normal(size=(900, 2))
    y = np.where(np.arange(900) < 12, truth, -1)
    wa, wb, log = quality.co_train(a, b, y)
    assert len(log) == quality.ROUNDS and log[-1][0] > 0 and log[-1][1] > 0
    right = np.mean(((b @ wb[:-1] + wb[-1]) > 0) == truth)
    _, alone, _ = quality.co_train(a, b, y, rounds=0)
    assert right > 0.9 and right > np.mean(((b @ alone[:-1] + alone[-1]) > 0) == truth) + 0.05


def test_sums_in_spark_are_those_of_the_matrices(spark):
    rng = np.random.default_rng(4)
    a, b = (rng.normal(size=(300, n)).astype("<f4") for n in (3, 2))
    rows = spark.createDataFrame([(bytearray(x.tobytes()), bytearray(y.tobytes())) for x, y in zip(a, b, strict=True)], "a binary, b binary").repartition(7)
    one, two = quality.Pool(a.astype(float), b.astype(float)), quality.SparkPool(rows, (3, 2))
    weights = (rng.normal(size=4), rng.normal(size=3))
    assert (one.histograms(weights) == two.histograms(weights)).all()
    bounds = [quality.sure_bounds(h, 0.4, 0.5, 0.6) for h in one.histograms(weights)]
    pairs = [(weights[0] / 2, weights[0]), (weights[1] / 2, weights[1])]
    for x, y in zip(one.sums(pairs, bounds), two.sums(pairs, bounds), strict=True):
        assert np.allclose(x[0], y[0]) and np.allclose(x[1], y[1]) and x[2] == y[2] > 0


def test_equal_texts_take_the_majority_label(spark):
    docs = spark.createDataFrame([(k, "bad word here" if k < 9 else f"fine text {k}") for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 8)) for k in range(40)], "doc_id long, toxic int")
    got = {r.doc_id: r.p_toxic for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert min(got[k] for k in range(9)) >= max(got[k] for k in range(9, 40))


def test_odd_inputs(spark):
    docs = spark.createDataFrame([(1, None, None, "x"), (2, "", None, "x"), (None, "word " * 30000, "en", "x"), (2, "", None, "x")], "doc_id long, text string, lang string, label string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.toxic for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()] == [False] * 4
    assert all(r.keep for r in quality.score(docs, quality.fit(docs, none)).collect())
    labels = spark.createDataFrame([(1, 1, 0), (1, None, None), (2, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == 4
    assert quality.score(docs, quality.fit(docs, labels)).count() == 4
    assert quality.score(docs.limit(0), quality.fit(docs, labels)).count() == 0
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0
    twins = docs.withColumnsRenamed({"label": "Quality"}).withColumn("keep", F.lit(7))
    assert quality.keep_good(twins, quality.fit(twins, labels)).columns == twins.columns
    many = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (2, 0), (2, None)], "doc_id long, quality int")
    assert {r.doc_id: r.label for r in text.one_label(many, "quality").collect()} == {1: 1, 2: 0}


def test_rows_that_repeat_an_id_are_one_text_of_the_fit(spark):
    """One labelled id in thousands of rows of different texts brings one text to the driver."""
    many = spark.range(4000).selectExpr("1L AS doc_id", "concat('some text number ', id) AS text")
    few = spark.createDataFrame([(k, ("vile " if k % 2 else "kind ") * 20) for k in range(2, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 2)) for k in range(1, 60)] + [(k, 1) for k in range(1000, 3000)], "doc_id long, toxic int")
    seen = []
    old = toxicity.choose_grams
    toxicity.choose_grams = lambda read, features: seen.append(read.count()) or old(read, features)
    try:
        model = toxicity.fit(many.unionByName(few), labels, sample=60)
    finally:
        toxicity.choose_grams = old
    assert seen == [3]  # the repeated id's least text, and the two texts of the others
    got = {r.doc_id: r.toxic for r in toxicity.score(few, model).collect()}
    assert len(got) == 58
