"""Mixture-controlled packing of documents into training sequences.

Method: each source is a queue of its documents' ids. Windows of so many sequences are filled in turn by deficit round-robin:
in every window a queue is served its quantum, window * weight / all weights, and what rounding to whole ids leaves is its
deficit, carried to the next window. Queues lie one after another on a line of cumulative weights, and after x ids of a
phase all queues up to weight c have been served floor(x * c / all weights) ids together. So windows are full, a deficit is
always less than one id, and since it is the remainder of a division by x alone, it carries over any number of windows and
into any task: a task knows where its documents' ids go without seeing those of another.

Where a queue runs dry before the others (targets that differ from the corpus) a phase ends, and the queues left share the
following windows in proportion to their weights. Without targets a source's weight is its ids, and all queues end together.

Steps: ids are made once and written as a table (two bytes an id); counts by source give the weights; each queue is cut into
buckets of some ``bucket`` ids by a hash of its documents, sums of buckets give each one's first place in its queue, and a
running sum within a bucket each document's. A hot source has more buckets, not larger ones.

What goes to the driver and to all tasks: one row for each queue. Sources whose quantum is less than two ids share the last
queue (with the largest source, where they are too few for one), so there are at most window * sequence / 2 queues (65,536).

Padding: all ids make one line, cut every ``sequence`` ids; what is left at its end becomes sequences of the powers of two
that add up to it, which need no padding. So nothing is padded at all.

Defined results: null or empty text is its end id alone; a null source is a queue of its own; rows without doc_id are packed
like others; equal rows are packed each; an empty table gives no piece. Texts of any length are encoded whole. Order within a
queue is by a hash of doc_id and text, so it doesn't depend on files or tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_words import ByteWords
from .common import cut, table

VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


@dataclass(frozen=True)
class Mix:
    sequence: int = 2048
    #: Sequences of a window.
    window: int = 64
    end_id: int = 1
    #: Ids of a bucket, about.
    bucket: int = 1 << 19
    #: Weight of each source (None: the null source). Unset: each source's ids.
    targets: Mapping[str | None, float] | None = None
    #: Weight of all sources without a target together; with 0 they come when the others are used up.
    rest: float = 0.0

    @property
    def ids(self) -> int:
        return self.sequence * self.window


# --- the schedule ------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Phase:
    """From the id ``start`` on, ``length`` ids. For each queue: ids served before, cumulative weight before it, weight. Windows lie on one grid over all phases, so the first one of a phase may be a rest."""

    start: int
    length: int
    served: list[int]
    before: list[int]
    weight: list[int]
    total: int
    window: int

    @property
    def shift(self) -> int:
        return self.start % self.window

    def edge(self, i: int, last: int) -> int:
        """Ids of the phase before its window i; last: its last window."""
        return 0 if i == 0 else self.length if i > last else i * self.window - self.shift

    @cached_property
    def last(self) -> int:
        """The last window: a rest of one where no queue would have to give back an id for that, else a whole one and the rest."""
        i = (self.shift + self.length - 1) // self.window
        return i if all(self.given(q, self.length) >= self.given(q, self.edge(i, i)) for q, w in enumerate(self.weight) if w) else max(0, i - 1)

    def up_to(self, x: int, c: int) -> int:
        return x * c // self.total

    def given(self, q: int, x: int) -> int:
        """Ids that queue q has been served once x ids of the phase are placed."""
        c = self.before[q]
        return self.up_to(x, c + self.weight[q]) - self.up_to(x, c)


def schedule(tokens: list[int], weights: list[int], window: int) -> list[Phase]:
    """Phases that serve all tokens of all queues; in each at least one queue runs dry, but for one id perhaps, which then has a phase of its own."""
    phases, start, served, left = [], 0, [0] * len(tokens), list(tokens)
    while any(left):
        own = [w if n else 0 for w, n in zip(weights, left, strict=True)]
        if not any(own):
            own = left[:]
        total = sum(own)
        length, first = min((n * total // w, q) for q, (n, w) in enumerate(zip(left, own, strict=True)) if w)
        if not length:
            own = [int(q == first) for q in range(len(own))]
            total, length = 1, left[first]
        elif length >= window and any(0 < w * window < 2 * total for w in own):
            raise ValueError("a window must hold two ids of every queue: take larger windows or targets")
        phase = Phase(start, length, served[:], [0, *np.cumsum(own, dtype=object)[:-1]], own, total, window)
        phases.append(phase)
        for q, w in enumerate(own):
            if w:
                got = phase.given(q, length)
                served[q] += got
                left[q] -= got
        start += length
    return phases


def places(phases: list[Phase], q: int, j: int, n: int) -> Iterator[tuple[int, int]]:
    """(place, ids) of the runs that ids j to j + n of queue q become, in order."""
    for p in phases:
        if not p.weight[q]:
            continue
        k = j - p.served[q]
        if k >= p.given(q, p.length):
            continue
        last = p.last
        i = min(last, (k * p.total // p.weight[q] + p.shift) // p.window)
        while n:
            x, y = p.edge(i, last), p.edge(i + 1, last)
            a, b = p.given(q, x), p.given(q, y)
            take = min(n, b - k)
            if take > 0:
                yield p.start + x + p.up_to(y, p.before[q]) - p.up_to(x, p.before[q]) + k - a, take
                j, k, n = j + take, k + take, n - take
            if i == last:
                break
            i += 1
        if not n:
            return


class Sequences:
    """Cuts runs of places into sequences."""

    def __init__(self, total: int, size: int):
        self.size, self.full = size, total // size
        self.ends, at, rest = [], self.full * size, total % size
        for bit in range(rest.bit_length() - 1, -1, -1):
            if rest >> bit & 1:
                self.ends.append((at, at + (1 << bit)))
                at += 1 << bit

    def cut(self, place: int, n: int) -> Iterator[tuple[int, int, int]]:
        """(sequence, offset, length)."""
        while n:
            s = place // self.size
            if s < self.full:
                first, end = s * self.size, (s + 1) * self.size
            else:
                k, (first, end) = next((k, e) for k, e in enumerate(self.ends) if e[0] <= place < e[1])
                s = self.full + k
            take = min(n, end - place)
            yield s, place - first, take
            place, n = place + take, n - take


# --- on tables ---------------------------------------------------------------------------------------------------


def encoded(docs: DataFrame, how: Mix, id_col: str, text_col: str, source_col: str, vocabulary: str, ranks: str) -> DataFrame:
    """doc_id, source, rank (a hash of doc_id and text), n_tokens and ids (little-endian, end id included), one row for each row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(F.col(id_col).cast("long"), text).alias("rank"), text.alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("rank", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteWords(vocabulary, ranks)
        for batch in batches:
            for part in encoder.slices(batch):
                ids, sizes = encoder.encode(part.column("text"), how.end_id)
                ends = np.concatenate([[0], np.cumsum(sizes)]) * ids.itemsize
                data = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), part.column("rank"), pa.array(sizes, pa.int64()), data], schema=schema)

    return read.mapInArrow(run, "doc_id long, source string, rank long, n_tokens long, ids binary")


def queues(tokens: DataFrame, how: Mix) -> tuple[list[tuple[str | None, int, int]], int]:
    """(source, ids, weight) of the sources with a queue of their own, null first, and the ids of all others."""
    counts = tokens.groupBy("source").agg(F.sum("n_tokens").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    if how.targets is None:
        named = counts.where(F.col("n").cast("decimal(38,0)") * how.ids >= 2 * total)
        own = [(r.source, r.n, r.n) for r in named.collect()]  # at most how.ids / 2 rows, as each has that share of all ids
    else:
        names = [x for x in how.targets if x is not None]
        own = [(r.source, r.n, round(how.targets[r.source] * 10**9)) for r in counts.where(F.col("source").isin(names) | (F.col("source").isNull() if None in how.targets else F.lit(False))).collect()]
    own.sort(key=lambda x: (x[0] is not None, x[0] or ""))
    others = total - sum(n for _, n, _ in own)
    if how.targets is None and own and 0 < others * how.ids < 2 * total:
        # Too few for a queue even together: the largest source shares it with them.
        largest = max(own, key=lambda x: x[1])
        own.remove(largest)
        others += largest[1]
    return own, others


def pack(docs: DataFrame, how: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", vocabulary: str = VOCABULARY, ranks: str = RANKS, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue and, if asked for, its ids."""
    spark = docs.sparkSession
    tokens = cut(encoded(docs, how, id_col, text_col, source_col, vocabulary, ranks), "ids")
    own, others = queues(tokens, how)
    sizes = [n for _, n, _ in own] + [others]
    weights = [w for _, _, w in own] + [others if how.targets is None else round(how.rest * 10**9)]
    phases, lines = schedule(sizes, weights, how.ids), Sequences(sum(sizes), how.sequence)
    numbers = spark.createDataFrame([(s, q, -(-n // how.bucket)) for q, (s, n, _) in enumerate(own)], "named string, queue int, buckets long")
    placed = tokens.join(F.broadcast(numbers), F.col("source").eqNullSafe(F.col("named")), "left").select("doc_id", "rank", "n_tokens", "ids", F.coalesce("queue", F.lit(len(own))).alias("queue"), F.pmod("rank", F.coalesce("buckets", F.lit(max(1, -(-others // how.bucket))))).alias("bucket"))
    before = Window.partitionBy("queue").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = placed.groupBy("queue", "bucket").agg(F.sum("n_tokens").alias("n")).select("queue", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("queue", "bucket").orderBy("rank", "doc_id", "ids").rowsBetween(Window.unboundedPreceding, -1)
    lined = placed.join(firsts, ["queue", "bucket"]).select("doc_id", "queue", "n_tokens", "ids", (F.col("base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).alias("first"))

    fields = [(x, pa.int64()) for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("queue", pa.int32())] + [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in fields]
            for i, q, n, data, first in zip(*(batch.column(x) for x in ("doc_id", "queue", "n_tokens", "ids", "first")), strict=True):
                i, q, n, data, first, start = i.as_py(), q.as_py(), n.as_py(), data.as_buffer(), first.as_py(), 0
                ids = np.frombuffer(data, f"<u{data.size // n}").astype("<u4")
                for place, run_ in places(phases, q, first, n):
                    for sequence, offset, length in lines.cut(place, run_):
                        piece = ids[start : start + length]
                        for column, x in zip(columns, (i, start, length, zlib.crc32(piece), n, sequence, offset, q, piece), strict=False):
                            column.append(x)
                        start += length
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], schema=schema)

    return lined.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue int" + ", ids array<int>" * with_ids)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
