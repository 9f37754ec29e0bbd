import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import common, quality, simhash


def shuffled(spark):
    """Bytes that all stages so far have written to shuffles."""
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_within_and_without_are_semi_and_anti_join(no_broadcast, kind):
    spark = no_broadcast
    ids = F.when(F.col("id") % 101 != 7, F.col("id") % 9000).cast(kind)  # nulls, repeats
    df = spark.range(20_000).select(F.col("id").alias("n"), ids.alias("doc_id"))
    for some in (df.where("n % 5 < 2").select("doc_id"), df.where("false"), df.where("doc_id is null"), df):
        for found, how in ((common.within(df, some), "left_semi"), (common.without(df, some), "left_anti")):
            assert found.columns == df.columns
            want = df.join(some.distinct(), "doc_id", how).select("n").collect()
            assert sorted(r.n for r in found.collect()) == sorted(r.n for r in want)


def texts_of(n):
    rng = np.random.default_rng(5)
    return [" ".join(map(str, rng.integers(0, 10**9, 200))) for _ in range(n)]


def test_unlabelled_texts_are_not_shuffled(no_broadcast):
    spark = no_broadcast
    texts = texts_of(1500)
    docs = common.materialise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "docs")
    labels = spark.createDataFrame([(k, k % 2) for k in range(100)], "doc_id long, quality int")
    before = shuffled(spark)
    assert quality.fit(docs, labels).content is not None
    assert shuffled(spark) - before < sum(map(len, texts)) / 4


def test_texts_of_documents_that_stay_are_not_shuffled(no_broadcast):
    spark = no_broadcast
    texts = texts_of(900)
    docs = spark.createDataFrame([(k, texts[k % 900]) for k in range(1500)], "doc_id long, text string")
    docs = common.materialise(docs, "docs")
    before = shuffled(spark)
    assert simhash.keep_one(docs).agg(F.sum(F.length("text"))).first()[0] == sum(map(len, texts))
    assert shuffled(spark) - before < sum(map(len, texts)) / 4


@pytest.mark.parametrize("kind", ["long", "string"])
def test_components_of_chains_and_stars_over_many_partitions(spark, kind):
    rng = np.random.default_rng(6)
    chain, others = rng.permutation(400).tolist(), rng.integers(1000, 1200, (150, 2)).tolist()
    edges = list(zip(chain, chain[1:], strict=False)) + others + [(5000, x) for x in range(5001, 5300)] + [(7, 7)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(root(a), root(b))] = min(root(a), root(b))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    named = [(f"{a:05d}", f"{b:05d}") if kind == "string" else (a, b) for a, b in edges]
    try:
        got = common.connected_components(spark.createDataFrame(named, f"a {kind}, b {kind}")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    want = {x: root(x) for e in edges for x in e if e[0] != e[1]}
    assert sorted((int(r.node), int(r.component)) for r in got) == sorted(want.items())
