"""The pipeline against its operators applied one after another by hand."""

import re

from docugrain.llm import bpe, decontaminate, near_dups, quality_rules, secrets


def test_pipeline_equals_its_stages_by_hand(spark):
    import corpus_pipeline

    at = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{at}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in quality_rules.quality_rules(docs).where("kept").collect()}
    left = {i: t for i, t in texts.items() if i in good}
    rows = spark.createDataFrame(list(left.items()), "doc_id long, text string")
    left = {i: left[i] for i in (r.doc_id for r in near_dups.near_duplicates(rows).where("kept").collect())}
    rows = spark.createDataFrame(list(left.items()), "doc_id long, text string")
    bad = {r.doc_id for r in decontaminate.overlaps(rows, spark.read.parquet(f"{at}/benchmark.parquet")).collect()}
    m = bpe.bpe(bpe.vocabulary_path())
    want = {}
    for i, t in left.items():
        if i not in bad:
            for a, _, b in sorted(secrets.base_spans(t), reverse=True):
                t = t[:a] + "\0" * (b - a) + t[b:]
            want[i] = m.encode(re.sub("\0+", "[SECRET]", t))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, at).collect()}
    assert {i: list(r.ids) for i, r in got.items()} == want and all(r.n_tokens == len(r.ids) for r in got.values())


def test_stages_keep_columns_and_bear_odd_rows(spark):
    import corpus_pipeline
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, None, 0), (None, "", 0), (2, "a b", 3), (2, "a b", 3), (3, "word " * 5000, 1)], "doc_id long, text string, n_chars long").withColumns({c: F.lit(0) for c in ("id", "kept", "label", "ids")})
    for docs in (rows, rows.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, "/root/testdata/sf0.001")
            if name != "encoding":
                assert got.columns == docs.columns, name
            got.count()


def test_words_that_a_worker_holds_have_a_bound():
    """Encoding held up to 800,000 words, some 250 MB, beside what earlier stages had left."""
    from docugrain.llm import bpe

    model = bpe.PrefixBPE(bpe.vocabulary_path())
    rows = [" ".join([*map(str, range(k, k + 10_000)), "the"]) for k in range(0, 250_000, 10_000)]
    sizes = [len(model.encode(t)) for t in rows]
    assert len(model.words) + len(model.older) <= bpe.HELD_IDS + 1 and b"the" in model.words
    fresh = bpe.PrefixBPE(bpe.vocabulary_path())
    assert [len(fresh.encode(t)) for t in rows[-2:]] == sizes[-2:] and fresh.encode(rows[0]) == model.encode(rows[0])
