"""Hard negatives by bit-sliced integer products.

Method: components are integers, held as bit-planes. A block of anchors meets a block of rows plane by plane, the most
significant (the sign) first: products of the planes seen so far give each pair's score but for the planes to come, which
add between -(2^k - 1) times the anchor's negative components and (2^k - 1) times its positive ones. So each pair has an
interval that every plane halves, and pairs whose interval can't qualify any more are dropped: those below the k-th best
lower end among an anchor's pairs, those outside all of its bands, and in a band those below the n-th best lower end of the
pairs that lie surely within. What is left after the last plane has exact scores. Bounds are exact integers: sums are held
in 32-bit floats, 64-bit floats, 64-bit integers or Python's integers, the first of them that holds every sum of the block exactly.

Two passes: an anchor's positives (its best rows of its label), then for each positive the best rows of other labels within
a band of its score. Rows are numbered in order of label, so that blocks hold few labels; the first pass makes only the
cells (block of anchors, block of rows) that share a label, the second one all. Each cell is one row of a join by block,
as large as two blocks are, and gives at most so many rows for an anchor (and positive) as are asked for; the best of all cells follow by
a window with a limit, which Spark applies in each task before it shuffles. Block sizes grow with the table up to bounds,
so cells stay few; no cell grows further.

Defined results: rows with a null id, label, vector or component, or a component that isn't finite, take no part; rows that
share an id are one row, the one of least label, then vector; shorter vectors count as followed by zeros, so an empty one has
score 0 with all; components beyond 2^62 count as 2^62 (and a score beyond a long as its end); an anchor without positive has no row; an empty table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, free, table


@dataclass(frozen=True)
class Mining:
    #: Rows whose id is divisible by this are anchors.
    every: int = 50
    #: A component x becomes floor(scale * x).
    scale: int = 256
    positives: int = 5
    negatives: int = 3
    #: Negatives have low * positive score <= 100 * score <= high * positive score.
    low: int = 50
    high: int = 95
    #: Blocks of rows and of anchors: the table over so many, within these sizes.
    row_blocks: int = 64
    rows: tuple[int, int] = (256, 32_768)
    anchor_blocks: int = 4
    anchors: tuple[int, int] = (64, 8_192)
    #: Pairs of a tile, in which a cell is worked off.
    tile: int = 1 << 20
    #: Share of pairs left at which a tile goes on with lists of them.
    sparse: float = 1 / 8


# --- bit-planes --------------------------------------------------------------------------------------------------


def integers(vectors: list[list[float]], scale: int) -> np.ndarray:
    """floor(scale * x) of all components as 64-bit integers, shorter vectors filled with zeros."""
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return np.clip(np.floor(scale * out), -(2.0**62), 2.0**62).astype(np.int64)


def plane_count(values: np.ndarray) -> int:
    """Planes that hold all values in two's complement."""
    top = max(int(values.max(initial=0)), -int(values.min(initial=0)) - 1, 0)
    return top.bit_length() + 1


def to_planes(values: np.ndarray) -> tuple[int, bytes]:
    n = plane_count(values)
    return n, np.packbits(np.stack([(values >> k) & 1 for k in range(n)]).astype(np.uint8)).tobytes()


def from_planes(data: bytes, n: int, rows: int, dims: int) -> np.ndarray:
    """(planes, rows, dims) of zeros and ones."""
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n * rows * dims).reshape(n, rows, dims)


class Sums:
    """Partial scores of anchors with rows, plane by plane, and what the planes to come can add."""

    def __init__(self, anchors: np.ndarray, planes: np.ndarray):
        n, dims = len(planes), min(anchors.shape[1], planes.shape[2])
        self.anchors, self.planes, self.next = anchors[:, :dims], planes[:, :, :dims], n
        up = np.maximum(self.anchors, 0).astype(object).sum(axis=1) if dims else np.zeros(len(anchors), object)
        down = np.minimum(self.anchors, 0).astype(object).sum(axis=1) if dims else np.zeros(len(anchors), object)
        most = max([int(b) - int(a) for a, b in zip(down, up, strict=True)], default=0) << n
        self.kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64 if most < 1 << 62 else object
        self.up, self.down, self.factors = up.astype(self.kind), down.astype(self.kind), self.anchors.astype(self.kind)

    def weight(self, k: int):
        return np.array((-1 if k == len(self.planes) - 1 else 1) * (1 << k), self.kind)[()]

    def add(self, so_far: np.ndarray) -> None:
        """The next plane, of all pairs (anchor, row)."""
        self.next -= 1
        so_far += self.weight(self.next) * (self.factors @ self.planes[self.next].T.astype(self.kind))

    def add_listed(self, so_far: np.ndarray, rows: np.ndarray, wanted: np.ndarray) -> None:
        """The next plane, of the wanted of the pairs (anchor i, rows[i, j])."""
        self.next -= 1
        i, j = np.nonzero(wanted)
        for at in range(0, len(i), 1 << 16):
            a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            so_far[a, b] += self.weight(self.next) * (self.factors[a] * self.planes[self.next][rows[a, b]].astype(self.kind)).sum(axis=1)

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """What to add to a partial score for the ends of its interval, for each anchor."""
        rest = np.array((1 << self.next) - 1, self.kind)[()]
        return (rest * self.down)[:, None], (rest * self.up)[:, None]


def best(values: np.ndarray, n: int, least) -> np.ndarray:
    """The n-th greatest value of each row, least where there are fewer."""
    if values.shape[1] < n:
        return np.full((len(values), 1), least, values.dtype)
    at = values.shape[1] - n
    return (np.sort(values, axis=1) if values.dtype == object else np.partition(values, at, axis=1))[:, at : at + 1]


def least_of(kind):
    return {np.float32: -np.inf, np.float64: -np.inf, np.int64: -(1 << 63), object: -(1 << 300)}[kind]


def mine(anchors: np.ndarray, planes: np.ndarray, allowed: np.ndarray, ids: np.ndarray, n: int, bands: tuple[np.ndarray, np.ndarray] | None, sparse: float) -> list[tuple[int, int, int, int]]:
    """(anchor, band, row, score) of each anchor's first n allowed rows, by score and then least id, in each of its bands; without bands, of all scores."""
    sums = Sums(anchors, planes)
    kind, none = sums.kind, least_of(sums.kind)
    if not allowed.any():
        return []
    so_far, alive, rows = np.zeros(allowed.shape, kind), allowed.copy(), None
    if bands is not None:
        lows, highs = (b.astype(object).astype(kind) for b in bands)
        bottom, top = lows.min(axis=1)[:, None], highs.max(axis=1)[:, None]

    def prune() -> None:
        nonlocal alive
        below, above = sums.ends()
        if bands is None:
            lower = np.where(alive, so_far + below, none)
            alive &= (so_far + above >= best(lower, n, none)).astype(bool)
            return
        alive &= ((so_far + above >= bottom) & (so_far + below <= top)).astype(bool)
        if rows is not None:
            lower, upper, useful = so_far + below, so_far + above, np.zeros_like(alive)
            for lo, hi in zip(lows.T[:, :, None], highs.T[:, :, None], strict=True):
                sure = (alive & (lower >= lo) & (upper <= hi)).astype(bool)
                useful |= ((upper >= lo) & (lower <= hi) & (upper >= best(np.where(sure, lower, none), n, none))).astype(bool)
            alive &= useful

    while sums.next:
        if rows is None:
            sums.add(so_far)
        else:
            sums.add_listed(so_far, rows, alive)
        prune()
        if rows is None and (sums.next == 0 or alive.mean() <= sparse):
            width = int(alive.sum(axis=1).max())
            if not width:
                return []
            # Lists: each anchor's rows that are left, side by side.
            i, j = np.nonzero(alive)
            counts = np.bincount(i, minlength=len(alive))
            place = np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts)
            rows, listed, left = np.zeros((len(alive), width), np.int64), np.zeros((len(alive), width), kind), np.zeros((len(alive), width), bool)
            rows[i, place], listed[i, place], left[i, place] = j, so_far[i, j], True
            so_far, alive = listed, left
            prune()
    out, own = [], ids[rows]
    for k in range(1 if bands is None else lows.shape[1]):
        fits = alive if bands is None else (alive & (so_far >= lows[:, k : k + 1]) & (so_far <= highs[:, k : k + 1])).astype(bool)
        for i in np.flatnonzero(fits.any(axis=1)):
            j = np.flatnonzero(fits[i])
            scores = [int(x) for x in so_far[i, j]]
            for s, _, r in sorted(zip([-x for x in scores], own[i, j].tolist(), rows[i, j].tolist(), strict=True))[:n]:
                out.append((int(i), k, r, -s))
    return out


# --- blocks ------------------------------------------------------------------------------------------------------

BLOCK = "block long, rows int, dims int, planes int, ids binary, labels binary, image binary, low binary, high binary"


def numbered(rows: DataFrame, name: str) -> tuple[DataFrame, int]:
    """rows with ``place``, from 0 in order of label and id, and how many there are. Places come from counts of range partitions, of which one row each is broadcast."""

    def run(batches):
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part), pa.int32()), pa.array(at + np.arange(batch.num_rows))], names=[*batch.schema.names, "part", "at"])
            at += batch.num_rows

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    ordered = cut(rows.repartitionByRange("label", "vec_id").sortWithinPartitions("label", "vec_id").mapInArrow(run, f"{schema}, part int, at long"), name)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    bases = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return ordered.join(F.broadcast(bases), "part").withColumn("place", F.col("base") + F.col("at")).drop("part", "at", "base"), ordered.count()


def size_of(n: int, blocks: int, bounds: tuple[int, int]) -> int:
    return min(max(-(-n // blocks), bounds[0]), bounds[1])


def blocked(rows: DataFrame, size: int, how: Mining) -> DataFrame:
    """One row for each block of places. A column ``scores`` of rows gives bands."""
    scored = "scores" in rows.columns

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        values = integers(group["vector"].to_pylist(), how.scale)
        n, image = to_planes(values)
        ids, labels = (np.array(group[c].to_pylist(), "<i8").tobytes() for c in ("vec_id", "label"))
        low = high = b""
        if scored:  # an empty band where there are fewer positives; a score below 0 has an empty one by itself
            own = [[*s, *[-1] * (how.positives - len(s))] for s in group["scores"].to_pylist()]
            low, high = (np.array([[f(s) for s in own_] for own_ in own], "<i8").tobytes() for f in (lambda s: -(-s * how.low // 100), lambda s: s * how.high // 100))
        return pa.table({"block": [group["block"][0].as_py()], "rows": pa.array([len(values)], pa.int32()), "dims": pa.array([values.shape[1]], pa.int32()), "planes": pa.array([n], pa.int32()), "ids": [ids], "labels": [labels], "image": [image], "low": [low], "high": [high]})

    return rows.withColumn("block", F.floor(F.col("place") / size)).groupBy("block").applyInArrow(run, BLOCK)


def cells(anchors: DataFrame, rows: DataFrame, how: Mining, banded: bool) -> DataFrame:
    """anchor_id, band, row_id and score of each cell's best pairs. anchors: blocks with ``other``, the block of rows to meet."""
    both = anchors.join(rows.select(F.col("block").alias("other"), *[F.col(c).alias(f"row_{c}") for c in ("rows", "dims", "planes", "ids", "labels", "image")]), "other")
    names, kinds = ["anchor_id", "band", "row_id", "score"], [pa.int64(), pa.int32(), pa.int64(), pa.int64()]

    def run(batches):
        for batch in batches:
            for x in batch.to_pylist():
                planes = from_planes(x["row_image"], x["row_planes"], x["row_rows"], x["row_dims"])
                ids, labels, row_ids, row_labels = (np.frombuffer(x[c], "<i8") for c in ("ids", "labels", "row_ids", "row_labels"))
                own = from_planes(x["image"], x["planes"], x["rows"], x["dims"]).astype(np.int64)
                weights = [(-1 if k == x["planes"] - 1 else 1) << k if k < 63 else -(1 << 63) for k in range(x["planes"])]
                anchor = sum((w * p for w, p in zip(weights, own, strict=True)), np.zeros(own.shape[1:], np.int64))
                bands = tuple(np.frombuffer(x[c], "<i8").reshape(-1, how.positives) for c in ("low", "high")) if banded else None
                wide = min(len(row_ids), 4096)
                tall = max(1, how.tile // wide)
                for a in range(0, len(ids), tall):
                    for b in range(0, len(row_ids), wide):
                        same = labels[a : a + tall, None] == row_labels[None, b : b + wide]
                        allowed = ~same if banded else same & (ids[a : a + tall, None] != row_ids[None, b : b + wide])
                        if banded:
                            allowed &= (bands[0][a : a + tall] <= bands[1][a : a + tall]).any(axis=1)[:, None]
                        found = mine(anchor[a : a + tall], planes[:, b : b + wide], allowed, row_ids[b : b + wide], how.negatives if banded else how.positives, tuple(z[a : a + tall] for z in bands) if banded else None, how.sparse)
                        if found:
                            i, band, j, s = zip(*found, strict=True)
                            s = [min(max(v, -(1 << 63)), (1 << 63) - 1) for v in s]
                            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((ids[a:][list(i)], band, row_ids[b:][list(j)], s), kinds, strict=True)], names=names)

    return both.mapInArrow(run, "anchor_id long, band int, row_id long, score long")


def first(found: DataFrame, n: int, *keys: str) -> DataFrame:
    """The first n rows of each key, with their rank."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "row_id"))).where(F.col("rank") <= n)


def hard_negatives(vectors: DataFrame, how: Mining = Mining(), id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    numbers = F.col(vector_col).cast("array<double>")
    read = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), numbers.alias("vector"))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    whole = read.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~odd)
    one = whole.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("x")).select("vec_id", "x.label", "x.vector")
    kept = cut(one, "vectors")
    rows, n = numbered(kept, "rows")
    anchors, n_anchors = numbered(kept.where(F.col("vec_id") % how.every == 0), "anchors")
    size, anchor_size = size_of(n, how.row_blocks, how.rows), size_of(n_anchors, how.anchor_blocks, how.anchors)
    blocks = cut(blocked(rows, size, how), "row-blocks")
    # First pass: the cells whose blocks have a label in common.
    by_label = lambda d, s, name: d.select("label", F.floor(F.col("place") / s).alias(name)).distinct()
    shared = by_label(anchors, anchor_size, "block").join(by_label(rows, size, "other"), "label").select("block", "other").distinct()
    found = cells(blocked(anchors, anchor_size, how).join(shared, "block"), blocks, how, banded=False)
    positives = cut(first(found, how.positives, "anchor_id").select("anchor_id", F.col("rank").alias("which"), F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # Second pass: all cells, with a band for each positive.
    scores = positives.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("which", "positive_score"))).alias("all")).select(F.col("anchor_id").alias("vec_id"), F.col("all.positive_score").alias("scores"))
    banded = blocked(anchors.join(scores, "vec_id"), anchor_size, how).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((n - 1) // size).cast("long"))))
    best_ = first(cells(banded, blocks, how, banded=True), how.negatives, "anchor_id", "band")
    negatives = cut(best_.select("anchor_id", (F.col("band") + 1).alias("which"), F.col("rank").cast("int").alias("rank"), F.col("row_id").alias("negative_id"), F.col("score").alias("negative_score")), "negatives")
    free(blocks)
    return negatives.join(positives, ["anchor_id", "which"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved))
