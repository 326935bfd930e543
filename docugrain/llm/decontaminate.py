"""Benchmark decontamination by SimHash of item-sized windows.

Method: every benchmark item has a SimHash of 256 bits over its pairs of neighbouring words, weighted by their count, and a window length, its own number of words.
A document's window of that length gets its fingerprint by a running sum of the pairs' signed bits. Fingerprints are
compared by multi-index Hamming blocks: of 85 blocks, two fingerprints within the radius differ in at most as many as the radius is, so they
agree in 85 less the radius at least, and all within it are found. Where a similarity of 80 in 100 leaves a run of words different, 15 bits in 100
differ, so no block of more than 6 bits could be sure to agree; asking for many small ones to agree leaves hardly any unrelated
item (README). Candidates are verified by the exact weighted-shingle similarity: shingles of
``shingle`` words, weighted by their count, sum of minima over sum of maxima, at least ``percent`` in 100.

Only windows that share a shingle with an item of their length are fingerprinted: the others have similarity 0, so no
result is lost, and documents without any are passed over after one look-up for each shingle.

Items are a stated query set: they go to the tasks in blocks of at most ``block_words`` words, all documents once for
each block, so that what is broadcast has a bound whatever the number of items.

Defined results: null, empty or blank text has no window; an item without words matches nothing; an item shorter than a
shingle is one shingle itself; equal items match alike, equal rows too; a text shorter than the item is compared whole; of several matching windows of one item
that overlap, the most similar (then the first) is reported. An empty benchmark gives no match.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, WordHashes, id_text, mix, table, texts, windows


@dataclass(frozen=True)
class Match:
    shingle: int = 5
    percent: int = 80
    #: Fingerprints within this distance are candidates. Where one run of words is replaced, a similarity of 80 in 100 leaves a ninth of
    #: the words different and a distance of 39 in the mean, with a deviation of 6; README.md has the measured misses.
    radius: int = 66
    block_words: int = 1_000_000


BITS = 256
#: Blocks of a fingerprint: all of three bits but the last one, of four.
BLOCKS = 85
#: Words whose running sums are held at once (a kilobyte each).
STRETCH = 1 << 14


def signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of 256 bits of a hash."""
    bits = np.stack([mix(hashes + U64(0x9E3779B97F4A7C15 * k % 2**64)) for k in range(BITS // 64)], axis=1)
    return np.unpackbits(bits.view(np.uint8).reshape(-1, BITS // 8), axis=1, bitorder="little").astype(np.int8) * 2 - 1


def fingerprints(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash bits of the windows of so many words at the starts, in order, over their pairs of neighbouring words: differences of running sums, then signs. Sums are made for a stretch of the text at a time."""
    out, k = np.zeros((len(starts), BITS), bool), 0
    if size > 1:
        hashes, size = windows(hashes, 2), size - 1
    while k < len(starts):
        last = max(k + 1, int(np.searchsorted(starts, starts[k] + STRETCH)))
        first, end = int(starts[k]), int(starts[last - 1]) + size
        running = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(signs(hashes[first:end]), axis=0, dtype=np.int32)])
        at = starts[k:last] - first
        out[k:last] = running[at + size] - running[at] > 0
        k = last
    return out


def blocks(bits: np.ndarray) -> np.ndarray:
    """Values of the blocks of each fingerprint."""
    ones = bits.astype(np.uint8)
    values = ones[:, : 3 * BLOCKS].reshape(-1, BLOCKS, 3) @ np.array([1, 2, 4], np.uint8)
    values[:, -1] += ones[:, -1] << 3
    return values


class Items:
    """The index of one block of items."""

    def __init__(self, items: list[tuple[int, str]], how: Match):
        self.how, hashes = how, WordHashes()
        self.ids, self.words, self.prints, self.shingles = [], [], [], []
        owners: dict[int, dict[int, list[int]]] = {}
        for item, text in items:
            w = hashes.of((text or "").encode().lower().split())
            if not len(w):
                continue
            k = len(self.ids)
            s = windows(w, how.shingle)
            self.ids.append(item)
            self.words.append(len(w))
            self.shingles.append(Counter(s.tolist()))
            self.prints.append(fingerprints(w, np.array([0]), len(w))[0])
            for at in set(s.tolist()):
                owners.setdefault(at, {}).setdefault(len(w), []).append(k)
        self.owners = owners
        self.sorted = np.sort(np.fromiter(owners, U64, len(owners)))
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.sorted >> U64(42)).astype(np.int64)] = True
        # Items by length, with the blocks of their fingerprints.
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in set(self.words):
            own = np.array([k for k, n in enumerate(self.words) if n == size])
            self.by_size[size] = own, blocks(np.array([self.prints[k] for k in own]))
        self.short = sorted({n for n in self.words if n < how.shingle})

    def agreeing(self, size: int, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of the windows and items of that length whose fingerprints agree in enough blocks to be within the radius, and perhaps are."""
        own, there = self.by_size[size]
        mine = blocks(bits)
        found = [np.nonzero((mine[k : k + 1] == there).sum(axis=1, dtype=np.uint8) >= BLOCKS - self.how.radius)[0] for k in range(len(mine))]
        return np.repeat(np.arange(len(mine)), [len(f) for f in found]), own[np.concatenate(found)] if found else own[:0]

    def within(self, size: int, bits: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(window, item, distance) for all items of that length within the radius."""
        for w, k in zip(*(x.tolist() for x in self.agreeing(size, bits)), strict=True):
            far = int((self.prints[k] != bits[w]).sum())
            if far <= self.how.radius:
                yield w, k, far

    def hits(self, at: np.ndarray) -> np.ndarray:
        """Places of the shingle hashes that some item has."""
        maybe = np.flatnonzero(self.filter[(at >> U64(42)).astype(np.int64)])
        if not len(maybe) or not len(self.sorted):
            return maybe[:0]
        place = np.minimum(np.searchsorted(self.sorted, at[maybe]), len(self.sorted) - 1)
        return maybe[self.sorted[place] == at[maybe]]

    def matches(self, hashes: np.ndarray) -> list[tuple]:
        """(item id, first word, words, distance, common, total) of a document's word hashes."""
        n, how, found = len(hashes), self.how, []
        if not n:
            return found
        starts: dict[int, set[int]] = {}
        step = how.shingle
        at = windows(hashes, step)
        for p in self.hits(at).tolist():
            for size in self.owners[int(at[p])]:
                if size >= step or n < step:
                    width = min(size, n)
                    starts.setdefault(size, set()).update(range(max(0, p + min(step, n) - width), min(p, n - width) + 1))
        for size in self.short:  # items shorter than a shingle are one shingle of their own length
            if n >= step:
                own = windows(hashes, size)
                for p in self.hits(own).tolist():
                    if size in self.owners[int(own[p])]:
                        starts.setdefault(size, set()).add(p)
        if not starts:
            return found
        for size, places in starts.items():
            width = min(size, n)
            order = np.array(sorted(places))
            best: dict[int, list] = {}
            shingles_of: tuple[int, Counter] = (-1, Counter())
            for part in range(0, len(order), STRETCH):
                here = order[part : part + STRETCH]
                for w, k, far in self.within(size, fingerprints(hashes, here, width)):
                    p = int(here[w])
                    if shingles_of[0] != p:
                        shingles_of = p, Counter(windows(hashes[p : p + width], how.shingle).tolist())
                    common = sum((shingles_of[1] & self.shingles[k]).values())
                    total = shingles_of[1].total() + self.shingles[k].total() - common
                    if common * 100 >= how.percent * total:
                        runs = best.setdefault(k, [])
                        if runs and p < runs[-1][1] + width:
                            if common * runs[-1][5] > runs[-1][4] * total:
                                runs[-1] = (self.ids[k], p, width, far, common, total)
                        else:
                            runs.append((self.ids[k], p, width, far, common, total))
            found += [r for runs in best.values() for r in runs]
        return sorted(found, key=lambda r: (r[1], r[0]))


def item_blocks(items: DataFrame, how: Match, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of a bounded number of words, drawn one partition at a time."""
    block, words = [], 0
    for row in items.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).orderBy(id_col).toLocalIterator():
        block.append((row[0], row[1] or ""))
        words += len(block[-1][1].split()) + 1
        if words >= how.block_words:
            yield block
            block, words = [], 0
    if block:
        yield block


MATCHES = "doc_id long, item_id long, first_word long, n_words long, distance long, n_common long, n_total long"


def overlaps(docs: DataFrame, items: DataFrame, how: Match = Match(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each place in docs that holds an item. No shuffle of documents: each is looked up by itself."""
    spark, mine = docs.sparkSession, id_text(docs, id_col, text_col)
    out = None
    for block in item_blocks(items, how, item_col, item_text_col):
        index = spark.sparkContext.broadcast(block)

        def run(batches, index=index):
            hashes, items_ = WordHashes(), Items(index.value, how)
            for batch in batches:
                rows = [(i.as_py(), *m) for i, t in zip(batch.column("doc_id"), texts(batch), strict=True) for m in items_.matches(hashes.of(t.encode().lower().split()))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[x.split()[0] for x in MATCHES.split(", ")])

        part = mine.mapInArrow(run, MATCHES)
        out = part if out is None else out.unionByName(part)
    out = out if out is not None else spark.createDataFrame([], MATCHES)
    return out.withColumn("similarity", F.col("n_common") / F.col("n_total"))


def clean(docs: DataFrame, items: DataFrame, how: Match = Match(), text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no item, with docs' own columns, in one scan for each block of items."""
    spark = docs.sparkSession
    for block in item_blocks(items, how, item_col, item_text_col):
        index = spark.sparkContext.broadcast(block)

        docs = docs.where(_free_of(index, how)(F.col(text_col).cast("string")))
    return docs


def _free_of(index, how: Match):
    """A predicate on texts: no item of the broadcast block is in it."""
    made: list = []

    def free(column: pa.Array) -> pa.Array:
        if not made:
            made.extend((Items(index.value, how), WordHashes()))
        return pa.array([not made[0].matches(made[1].of((t.as_py() or "").encode().lower().split())) for t in column], pa.bool_())

    free.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(free, "boolean")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
