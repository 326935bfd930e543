"""Nearest vectors by inverted lists.

Vectors of length 1 are dealt to the list of the centroid that they are nearest to; a query looks only into the lists of its ``probes`` nearest
centroids (all of them: exact). Lists are kept as blocks of rows in a table, and queries meet them, in blocks too, by equality
on the list: a task works off one block of queries with one of rows, and keeps k rows for each query.

Centroids are fitted on the driver on at most ``sample`` vectors (the first by a hash of their ids); all vectors are dealt. They are sent to all tasks: ``lists`` times the dimensions.
Zero vectors have similarity 0 with all; null vectors are left out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .corpus import _unit

SAMPLE, BLOCK, ASKED = 20_000, 4096, 1024
BLOCKS = "list int, n int, ids binary, vectors binary"


def centroids(vectors: DataFrame, id_: str, vector: str, lists: int, sample: int = SAMPLE, rounds: int = 10) -> np.ndarray:
    """Spherical k-means on a bounded sample. Fewer lists where the sample has fewer distinct vectors."""
    some = vectors.where(F.col(vector).isNotNull()).select(id_, vector).orderBy(F.xxhash64(id_), id_).limit(sample).toArrow()
    x = _unit(some.column(1))
    centers = np.unique(x[: max(lists * 4, lists)], axis=0)
    centers = centers[np.random.default_rng(3).permutation(len(centers))[:lists]]
    for _ in range(rounds if len(centers) else 0):
        own = (x @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        empty = ~sums.any(axis=1)
        sums[empty] = centers[empty]
        centers = sums / np.linalg.norm(sums, axis=1, keepdims=True).clip(1e-300)
    return centers


def _dealt(vectors: DataFrame, id_: str, vector: str, centers: np.ndarray, probes: int) -> DataFrame:
    """(list, id, unit) for each vector and its nearest lists."""
    sent, wide = vectors.sparkSession.sparkContext.broadcast(centers), probes < len(centers)

    def run(batches):
        c = sent.value
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            if batch.num_rows and len(c):
                unit = _unit(batch.column(1))
                near = np.argpartition(-(unit @ c.T), probes - 1, axis=1)[:, :probes] if wide else np.broadcast_to(np.arange(len(c)), (len(unit), len(c)))
                rows = np.repeat(np.arange(len(unit)), near.shape[1])
                data = [u.tobytes() for u in unit]
                yield pa.RecordBatch.from_arrays([pa.array(near.reshape(-1), pa.int32()), batch.column(0).take(pa.array(rows)).cast(pa.int64()), pa.array([data[r] for r in rows], pa.binary())], names=["list", "id", "unit"])

    return vectors.select(id_, vector).mapInArrow(run, "list int, id long, unit binary")


def _blocked(rows: DataFrame, size: int) -> DataFrame:
    """One row for each some ``size`` rows of a list. Counts of lists, one row each, are small."""
    pieces = rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / size).alias("pieces"))

    def run(group: pa.Table) -> pa.Table:
        ids = np.array(group["id"].to_pylist(), "<i8")
        return pa.table({"list": [group["list"][0].as_py()], "n": [len(ids)], "ids": [ids.tobytes()], "vectors": [b"".join(group["unit"].to_pylist())]}, schema=pa.schema([("list", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())]))

    return rows.join(F.broadcast(pieces), "list").withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces"))).drop("pieces").groupBy("list", "piece").applyInArrow(run, BLOCKS)


def index(vectors: DataFrame, id_: str, vector: str, centers: np.ndarray) -> DataFrame:
    """The lists as blocks, to be written as a table: each vector is in the list of its nearest centroid."""
    return _blocked(_dealt(vectors, id_, vector, centers, 1), BLOCK)


def nearest(queries: DataFrame, id_: str, vector: str, lists: DataFrame, centers: np.ndarray, k: int, probes: int | None = None) -> DataFrame:
    """(query, place, id, similarity): the k vectors of greatest cosine with each query in its lists, itself left out, ties by id. Without probes all lists: exact."""
    asked = _blocked(_dealt(queries, id_, vector, centers, min(probes or len(centers), len(centers)) or 1), ASKED)
    met = asked.select("list", F.col("n").alias("asked"), F.col("ids").alias("queries"), F.col("vectors").alias("units")).join(lists, "list")

    def run(batches):
        for batch in batches:
            for x in batch.to_pylist():
                asking, there = np.frombuffer(x["queries"], "<i8"), np.frombuffer(x["ids"], "<i8")
                near = np.frombuffer(x["units"]).reshape(x["asked"], -1) @ np.frombuffer(x["vectors"]).reshape(x["n"], -1).T
                near[asking[:, None] == there[None]] = -np.inf
                order = np.lexsort((np.broadcast_to(there, near.shape), -near), axis=1)[:, :k]
                best = np.take_along_axis(near, order, 1)
                i, j = np.nonzero(best > -2)
                yield pa.RecordBatch.from_arrays([pa.array(asking[i]), pa.array(there[order[i, j]]), pa.array(best[i, j])], names=["query", "id", "similarity"])

    found = met.mapInArrow(run, "query long, id long, similarity double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("place", place).where(F.col("place") <= k).select("query", "place", F.col("id").alias(id_), "similarity")
