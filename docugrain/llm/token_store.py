"""Token ids in directly addressable codes, in ascending order of document.

Method: each id is cut into chunks of fixed widths, lowest bits first. Level k holds the k-th chunk of every id that has
one, packed at its width; a bitmap beside it says which of these ids go on to the next level, and a rank directory
(ones before every 512 bits) turns a place on one level into the place on the next. So any one id is read from its
position by a few look-ups, and no block is decoded.

File format: a segment is a self-contained image (header of little-endian uint32: magic, documents, ids, levels, documents without doc_id, then for
each level width and count; then doc ids int64, those without one first (as 0), first positions uint32; then for each level the packed chunks, bitmap
and directory, each padded to 8 bytes). Segments are rows of a table that Spark writes and reads (part, seq, image), in
order of doc_id over parts and within them, each with the ids before it in its part, so that any file system that Spark reaches holds it and lost tasks are redone.

Defined results: null or empty text gives the end id alone; repeated rows are stored each, equal doc_ids side by side
(in order of a hash of their text over parts, of the text within one); rows without doc_id come before all others; an empty table gives no segment. A text of any length is encoded whole, in one segment.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, new_path, table, texts

VOCABULARY = "word_bpe_49k.json"
MAGIC = 0x32434144
#: Chunk widths in bits. Ids below 2**11 take 12 bits with their bitmap, others 17 or 18; the last level takes what is left of 32 bits.
WIDTHS = (11, 5, 16)
RANK_EVERY = 512
#: A segment ends with the document that reaches so many ids.
SEGMENT_IDS = 1 << 20


# --- the codes ---------------------------------------------------------------------------------------------------


def pack(values: np.ndarray, width: int) -> bytes:
    bits = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=width, bitorder="little")
    return np.packbits(bits.reshape(-1), bitorder="little").tobytes()


def unpack(data: np.ndarray, width: int, count: int) -> np.ndarray:
    """Values of so many bits each, read as unaligned 32-bit words."""
    if not count:
        return np.zeros(0, np.uint32)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    start = np.arange(count, dtype=np.int64) * width
    at = start >> 3
    word = padded[at].astype(np.uint32) | padded[at + 1].astype(np.uint32) << np.uint32(8) | padded[at + 2].astype(np.uint32) << np.uint32(16)
    return (word >> (start & 7).astype(np.uint32)) & np.uint32((1 << width) - 1)


def _pad(data: bytes) -> bytes:
    return data + bytes(-len(data) % 8)


def encode_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, widths: tuple = WIDTHS) -> bytes:
    """doc_ids: in ascending order, None first."""
    ids = ids.astype(np.uint32)
    head, body, rest = [MAGIC, len(doc_ids), len(ids), len(widths), sum(x is None for x in doc_ids)], [], ids
    firsts = np.zeros(len(doc_ids) + 1, np.uint32)
    np.cumsum(lengths, out=firsts[1:])
    for k, width in enumerate(widths):
        more = (rest >> np.uint32(width)) > 0 if k < len(widths) - 1 else np.zeros(len(rest), bool)
        ones = np.concatenate([[0], np.cumsum(np.add.reduceat(more, np.arange(0, len(more), RANK_EVERY)))]) if len(more) else np.zeros(1)
        head += [width, len(rest)]
        body += [pack(rest & np.uint32((1 << width) - 1), width), np.packbits(more, bitorder="little").tobytes(), ones.astype("<u4").tobytes()]
        rest = rest[more] >> np.uint32(width)
    return b"".join([_pad(np.array(head, "<u4").tobytes()), np.array([x or 0 for x in doc_ids], "<i8").tobytes(), _pad(firsts.astype("<u4").tobytes()), *map(_pad, body)])


class Segment:
    """A segment's image; nothing is decoded before it is asked for."""

    def __init__(self, image: bytes):
        self.data = np.frombuffer(image, np.uint8)
        magic, self.n_docs, self.n_ids, levels, nulls = map(int, np.frombuffer(image, "<u4", 5))
        if magic != MAGIC:
            raise ValueError("not a token segment")
        head = np.frombuffer(image, "<u4", 2 * levels, 20)
        at = (20 + 8 * levels + 7) // 8 * 8
        self.doc_ids = pa.array(np.frombuffer(image, "<i8", self.n_docs, at), mask=np.arange(self.n_docs) < nulls)
        at += 8 * self.n_docs
        self.firsts = np.frombuffer(image, "<u4", self.n_docs + 1, at)
        at += (4 * (self.n_docs + 1) + 7) // 8 * 8
        self.levels = []
        for k in range(levels):
            width, count = int(head[2 * k]), int(head[2 * k + 1])
            own = []
            for size in ((width * count + 7) // 8, (count + 7) // 8, 4 * (1 + -(-count // RANK_EVERY))):
                own.append(self.data[at : at + size])
                at += (size + 7) // 8 * 8
            self.levels.append((width, count, own[0], own[1], own[2].view("<u4") if own[2].flags.aligned else np.frombuffer(own[2].tobytes(), "<u4")))

    def token(self, place: int) -> int:
        """The id at a position, by random access."""
        value = shift = 0
        for width, count, chunks, bitmap, ranks in self.levels:
            if not 0 <= place < count:
                raise IndexError(place)
            bit = place * width
            value |= (int.from_bytes(chunks[bit >> 3 : (bit >> 3) + 4].tobytes(), "little") >> (bit & 7) & ((1 << width) - 1)) << shift
            if not bitmap[place >> 3] >> (place & 7) & 1:
                break
            block = place // RANK_EVERY
            inside = np.unpackbits(bitmap[block * RANK_EVERY // 8 : (place >> 3) + 1], bitorder="little")[: place - block * RANK_EVERY]
            place, shift = int(ranks[block]) + int(inside.sum()), shift + width
        return value

    def all_ids(self) -> np.ndarray:
        """Every id of the segment, level by level."""
        total, places, shift = np.zeros(self.n_ids, np.uint32), None, 0
        for width, count, chunks, bitmap, _ in self.levels:
            if not count:
                break
            values = unpack(chunks, width, count) << np.uint32(shift)
            if places is None:
                total |= values
                places = np.arange(count)
            else:
                total[places] |= values
            places, shift = places[np.unpackbits(bitmap, count=count, bitorder="little").astype(bool)], shift + width
        return total


# --- encoding with the tokenizers library ------------------------------------------------------------------------


#: Words that an encoder holds before it starts anew (some 200 bytes each); results don't depend on it.
HELD = 1_200_000


class Numbers(dict):
    """A word's number, given on first sight; new words wait in pending until the library has seen them."""

    def __init__(self):
        self.pending: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self)
        self.pending.append(word)
        return k


class LibraryWords:
    """Ids of texts by the tokenizers library. White space always splits for this vocabulary, so each distinct word is given to the library once and kept in a memo of bounded size.

    The vocabulary lower-cases, so A-Z are lowered before; not where a special token could come of it, nor beside combining
    marks (U+0300 to U+036F, bytes CC and CD), as some letters compose with them in lower case only."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(self.library.to_str())
        self.lowers = '"Lowercase"' in json.dumps(spec["normalizer"])
        self.guard = [b"\xcc", b"\xcd", *{x["content"].encode()[:2] for x in spec["added_tokens"]}]
        self.forget()

    def forget(self) -> None:
        self.number, self.used = Numbers(), 0
        self.flat = np.zeros(1 << 20, np.uint32)
        self.starts, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def learn(self) -> None:
        words = self.number.pending
        # One call for all new words; word_ids names the word that each id is of. A word may give no id.
        got = self.library.encode([w.decode() for w in words], is_pretokenized=True, add_special_tokens=False)
        ids = np.array(got.ids, np.uint32)
        sizes = np.bincount(np.array(got.word_ids, np.int64), minlength=len(words))
        first, last = len(self.number) - len(words), len(self.number)
        while last > len(self.starts):
            self.starts, self.sizes = np.concatenate([self.starts, np.zeros_like(self.starts)]), np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.sizes[first:last] = sizes
        self.starts[first:last] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.number.pending.clear()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. The library sees the new words of all of them in one call."""
        if len(self.number) > HELD:
            self.forget()
        numbers, counts = [], []
        for text in texts:
            raw = text.encode()
            if self.lowers and not any(g in raw for g in self.guard):
                raw = raw.lower()
            words = raw.split()
            numbers.append(np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)))
            counts.append(len(words))
        if self.number.pending:
            self.learn()
        at = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        sizes = self.sizes[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.arange(ends[-1]) + np.repeat(self.starts[at] - ends[:-1], sizes)]
        return np.split(ids, ends[np.cumsum(counts)[:-1]]) if numbers else []


_words: dict[str, LibraryWords] = {}


def _encoder(name: str) -> LibraryWords:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if name not in _words:
        import public_tokenizers

        _words[name] = LibraryWords(public_tokenizers.path(name))
    return _words[name]


# --- writing and reading -----------------------------------------------------------------------------------------

#: Characters of texts that are encoded together, and bytes of input for each part, about.
TOGETHER, PART_BYTES = 2_000_000, 64 << 20


def parts_for(docs: DataFrame) -> int:
    """Parts by the size of the input, at least as many as the session shuffles to."""
    size, least = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A source of unknown size says 2**63 - 1, or more after joins.
    return least if size >= 1 << 60 else max(least, min(-(-size // PART_BYTES), 200_000))


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> None:
    """Encodes docs and writes the segments at path. One shuffle, by range of doc_id, of the texts; ids are made after it and go straight to the files."""
    ordered = id_text(docs, id_col, text_col).repartitionByRange(partitions or parts_for(docs), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("image", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, seq, before, docs_, sizes, held, total = TaskContext.get().partitionId(), _encoder(vocabulary), 0, 0, [], [], [], 0

        def segment():
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, seq, before, len(docs_), total, encode_segment(docs_, sizes, np.concatenate(held))), schema.types, strict=True)], schema=schema)

        def encoded():
            own, some, chars = [], [], 0
            for batch in batches:
                for i, text in zip(batch.column("doc_id"), texts(batch), strict=True):
                    own.append(i.as_py())
                    some.append(text)
                    chars += len(text)
                    if chars >= TOGETHER:
                        yield from zip(own, encoder.encode(some), strict=True)
                        own, some, chars = [], [], 0
            yield from zip(own, encoder.encode(some), strict=True)

        for i, ids in encoded():
            if end_id is not None:
                ids = np.append(ids, np.uint32(end_id))
            docs_.append(i)
            sizes.append(len(ids))
            held.append(ids)
            total += len(ids)
            if total >= SEGMENT_IDS:
                yield segment()
                seq, before, docs_, sizes, held, total = seq + 1, before + total, [], [], [], 0
        if docs_:
            yield segment()

    # Codes are packed bits: a compressor would only force blocks to be decoded.
    ordered.mapInArrow(run, "part int, seq int, before long, n_docs long, n_ids long, image binary").write.option("compression", "none").parquet(path)


def parts_at(segments: DataFrame) -> DataFrame:
    """(part, base): the ids before each part. One row for each part, so as many as the writer had tasks (200,000 at most by itself), each of 12 bytes."""
    from pyspark.sql import Window

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return segments.groupBy("part").agg(F.sum("n_ids").alias("t")).select("part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, the ids."""
    segments = spark.read.parquet(path)
    data = segments.join(F.broadcast(parts_at(segments)), "part").select("image", (F.col("base") + F.col("before")).alias("start"))
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image, start in zip(batch.column("image"), batch.column("start"), strict=True):
                s = Segment(image.as_py())
                ids, first = s.all_ids().astype("<u4"), s.firsts.astype(np.int64)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
                own = [s.doc_ids, pa.array(first[:-1] + start.as_py()), pa.array(np.diff(first)), pa.array(crc, pa.int64())]
                if with_ids:
                    own.append(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(own, schema=schema)

    return data.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def tokens_at(spark: SparkSession, path: str, places: DataFrame, column: str = "place") -> DataFrame:
    """(place, id) for each distinct place of all documents' ids that the files hold, by random access with the rank directories.

    Places find their segment by blocks of SEGMENT_IDS places; each segment's places, at most as many as it has ids, are gathered beside its image."""
    segments = spark.read.parquet(path)
    index = segments.select("part", "seq", "before", "n_ids").join(F.broadcast(parts_at(segments)), "part").withColumn("start", F.col("base") + F.col("before"))
    blocks = index.where("n_ids > 0").select("part", "seq", "start", "n_ids", F.explode(F.sequence(F.floor(F.col("start") / SEGMENT_IDS), F.floor((F.col("start") + F.col("n_ids") - 1) / SEGMENT_IDS))).alias("block"))
    asked = places.select(F.col(column).cast("long").alias("place")).where("place >= 0").distinct().withColumn("block", F.floor(F.col("place") / SEGMENT_IDS))
    found = asked.join(blocks, "block").where("place >= start and place < start + n_ids")
    wanted = found.groupBy("part", "seq", "start").agg(F.collect_list("place").alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image, start, own in zip(batch.column("image"), batch.column("start"), batch.column("places"), strict=True):
                s, own, start = Segment(image.as_py()), own.as_py(), start.as_py()
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([s.token(k - start) for k in own], pa.int64())], names=["place", "id"])

    return segments.select("part", "seq", "image").join(wanted, ["part", "seq"]).select("image", "start", "places").mapInArrow(run, "place long, id long")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path, with_ids=False)
