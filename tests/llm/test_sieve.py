"""Rows chosen by id without a shuffle of their texts."""

import random

import pytest
from pyspark.sql import functions as F

from docugrain.llm import common, near_dups


def shuffled_bytes(df) -> int:
    """Bytes that the exchanges of df's own plan, once run, have written."""
    frame = df._jdf
    frame.collectToPython()
    todo, total = [frame.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "ShuffleExchangeExec":
            total += node.metrics().apply("dataSize").value()
        inner = node.executedPlan() if kind == "AdaptiveSparkPlanExec" else node.plan() if kind.endswith("QueryStageExec") else None
        todo += [inner] if inner is not None else [node.children().apply(i) for i in range(node.children().size())]
    return total


@pytest.fixture
def no_small_tables(spark):
    """As if every table of ids were too large for Spark to broadcast it by itself."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def some_texts():
    """Of 600 texts of 60 words 60 are near copies of the ones before and 30 exact ones; one doc_id has two rows, one none."""
    rnd = random.Random(5)
    rows = [(i, " ".join(f"w{rnd.randrange(10**6)}" for _ in range(60))) for i in range(600)]
    for i in range(5, 600, 10):
        rows[i] = (i, rows[i - 1][1] + " more")
    for i in range(7, 600, 20):
        rows[i] = (i, rows[i - 2][1])
    return [*rows, rows[100], (None, rows[0][1])]


def test_a_sieve_holds_all_its_ids_and_few_others(spark):
    rows = spark.range(-2000, 20000).withColumn("text", F.lit("x"))
    for ids in (range(0, 20000, 7), range(-3, 2), ()):
        by = common.sieve(spark.createDataFrame([(i,) for i in [*ids, *ids]], "id long"))
        held, rest = ({r.id for r in common.sifted(rows, "id", by, held=x).collect()} for x in (True, False))
        assert set(ids) <= held and not held & rest and len(held) + len(rest) == 22000
        assert len(held) - len(set(ids)) < 22000 / 40
    odd = spark.createDataFrame([(None, 1, 2), (3, 4, 5)], "id long, `a.b` int, bits int")
    by = common.sieve(spark.createDataFrame([(3,)], "id long"))
    assert [tuple(r) for r in common.sifted(odd, "id", by).collect()] == [(3, 4, 5)]
    assert [tuple(r) for r in common.sifted(odd, "id", by, held=False).collect()] == [(None, 1, 2)]


def test_a_full_sieve_changes_no_result(spark, monkeypatch, no_small_tables):
    rows = spark.createDataFrame(some_texts(), "doc_id long, text string")
    want = sorted(map(str, near_dups.drop_duplicates(rows).collect()))
    monkeypatch.setattr(common, "SIEVE_ROWS", 1)
    monkeypatch.setattr(common, "ROW", 8)
    assert sorted(map(str, near_dups.drop_duplicates(rows).collect())) == want


def test_texts_are_not_shuffled_to_drop_duplicates(spark, no_small_tables):
    texts = some_texts()
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    whole = sum(len(t) for _, t in texts)
    left = near_dups.drop_duplicates(rows)
    assert shuffled_bytes(left) < whole / 5
    copies = {i for i in range(5, 600, 10)} | {i for i in range(7, 600, 20)}
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == [i for i in range(600) if i not in copies]
    assert left.where("doc_id is null").count() == 1
    wanted = common.cut(spark.createDataFrame([(4,), (5,)], "id long"), "wanted")
    assert shuffled_bytes(near_dups.full_sets(rows, wanted, near_dups.Tensor(), "doc_id", "text")) < whole / 5


def test_stages_bound_arrow_batches(spark):
    import corpus_pipeline

    at = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(at)
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    try:
        for setting, want in (("10000", common.BATCH), ("0", common.BATCH), ("7", 7)):
            for _, stage in corpus_pipeline.STAGES:
                spark.conf.set(at, setting)
                stage(spark, docs.limit(0), "/root/testdata/sf0.001")
                assert int(spark.conf.get(at)) == want
                if setting != "10000":
                    break
    finally:
        spark.conf.set(at, before)
