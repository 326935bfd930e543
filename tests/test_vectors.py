"""Inverted lists against all vectors."""

import numpy as np
from pyspark.sql import functions as F

from docugrain.operators import corpus, vectors
from docugrain.plans import catalog

SF = "/root/testdata/sf0.1"


def test_recall_of_the_registered_probes(spark):
    pairs = lambda rows: {(r["query"], r.vec_id) for r in rows.collect()}
    exact, got = pairs(catalog.cosine_topk(spark, SF)), pairs(catalog.lists_probes_topk(spark, SF))
    assert len(got) == len(exact) and len(exact & got) >= 0.95 * len(exact)


def test_few_lists_suffice_for_vectors_in_groups_and_all_lists_are_exact(spark, tmp_path):
    rng = np.random.default_rng(5)
    groups = rng.normal(size=(20, 16))
    x = groups[rng.integers(0, 20, 1500)] + 0.1 * rng.normal(size=(1500, 16))
    x[7] = 0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9999, None)], "id long, v array<double>")
    centers = vectors.centroids(rows, "id", "v", 20)
    vectors.index(rows, "id", "v", centers).write.parquet(f"{tmp_path}/lists")
    lists = spark.read.parquet(f"{tmp_path}/lists")
    assert lists.agg(F.sum("n")).first()[0] == 1500 and lists.select("list").distinct().count() > 10
    unit = x / np.linalg.norm(x, axis=1, keepdims=True).clip(1e-300)
    near = np.round(unit @ unit.T, 9)
    want = {(q, n + 1, i) for q in range(0, 1500, 50) for n, i in enumerate(sorted((i for i in range(1500) if i != q), key=lambda i: (-near[q, i], i))[:5])}
    asked = rows.where("id % 50 = 0")
    found = lambda probes: vectors.nearest(asked, "id", "v", lists, centers, 5, probes).collect()
    exact = found(None)
    assert {(r["query"], r.place, r.id) for r in exact} == want
    few = {(r["query"], r.id) for r in found(2)}
    assert len(few & {(q, i) for q, _, i in want}) >= 0.95 * len(want)
    none = rows.limit(0)
    assert vectors.nearest(asked, "id", "v", vectors.index(none, "id", "v", centers), centers, 5).count() == 0
    assert vectors.nearest(none, "id", "v", lists, centers, 5).count() == 0
    nothing = vectors.centroids(none, "id", "v", 4)
    assert len(nothing) == 0 and vectors.index(none, "id", "v", nothing).count() == 0


def test_nearest_holds_a_bounded_part_of_what_it_compares():
    """All queries of a block by all rows of a batch were held together."""
    rng, k, n = np.random.default_rng(4), 3, corpus.AT_ONCE
    assert n <= 1024
    ids, there = np.arange(0, 40, 2), np.arange(60)[::-1].copy()
    near = rng.integers(-2, 3, (20, 60)).astype(float)
    best, who = np.full((20, k), -np.inf), np.full((20, k), -1, np.int64)
    for a in range(0, 60, 7):
        corpus._keep_best(best, who, ids, near[:, a : a + 7].copy(), there[a : a + 7])
    for r, i in enumerate(ids):
        want = sorted((-s, t) for s, t in zip(near[r], there, strict=True) if t != i)[:k]
        assert [(-s, t) for s, t in zip(best[r], who[r], strict=True)] == want
