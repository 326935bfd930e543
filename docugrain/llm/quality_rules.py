"""Quality rules: base word and line counts, then compression bands.

Method: every text is compressed whole and in fixed chunks with zstandard. The ratio (compressed / raw bytes) must lie
in a band that depends on the length, since short texts compress worse: below it a text is repetitive, above it
incompressible. A text is rejected if the whole is outside its band, or if chunks (the last one, of any length, too) that
make up more than ``chunk_share`` of its bytes are outside the bands of their own lengths; a text of one chunk is its chunk.

Defined results: null or empty text has no words and fails (under ``min_words``); equal rows are judged alike, each on
its own; texts of any length are read whole; further columns of the input are ignored here and kept by ``keep``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, id_text, map_rows, table, texts, windows

SPACES = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    max_repeat_percent: int = 30
    repeat_window: int = 8
    level: int = 3
    #: (bytes below, lowest ratio, highest ratio), of whole texts and of chunks alike; the last holds for all longer ones.
    #: The lowest lie under what prose of that length reaches (its ratios fall by about 0.03 with each doubling) and over lists, tables
    #: and words that carry the same signs; the highest between prose and random letters and digits (0.71 of long texts). Below 128
    #: bytes random text can't be told apart, and hexadecimal digits (0.51 to 0.57) compress as prose does.
    bands: tuple = (
        (64, 0.60, 9.0), (128, 0.58, 9.0), (144, 0.60, 1.0), (160, 0.60, 0.975), (176, 0.59, 0.945), (192, 0.58, 0.92), (224, 0.57, 0.895), (256, 0.56, 0.865), (320, 0.55, 0.84), (384, 0.53, 0.815), (512, 0.52, 0.78),
        (768, 0.50, 0.75), (1024, 0.485, 0.72), (1536, 0.465, 0.69), (2048, 0.455, 0.69), (3072, 0.445, 0.69), (4096, 0.435, 0.69), (6144, 0.42, 0.69), (8192, 0.41, 0.69), (12288, 0.405, 0.69), (16384, 0.395, 0.69), (32768, 0.385, 0.69),
        (float("inf"), 0.37, 0.69),
    )
    chunk_bytes: int = 4096
    chunk_share: float = 1 / 3


def outside(size: int, ratio: float, rules: Rules) -> bool:
    """Whether a text or chunk of so many bytes is outside its band."""
    low, high = next((lo, hi) for below, lo, hi in rules.bands if size < below)
    return not low <= ratio <= high


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunk_share double"


def measure(text: str, rules: Rules, hashes: WordHashes, compressor) -> tuple:
    raw = text.encode()
    words = raw.split()
    n = len(words)
    word_chars = len(text) - sum(raw.count(c) for c in SPACES)
    symbols = sum(raw.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0
    if n > rules.repeat_window:
        at = windows(hashes.of(words), rules.repeat_window)
        order = np.argsort(at, kind="stable")
        same = at[order[1:]] == at[order[:-1]]
        if same.any():
            hit = np.zeros(len(at), bool)
            hit[order[1:][same]] = hit[order[:-1][same]] = True
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, np.flatnonzero(hit), 1)
            np.add.at(edge, np.flatnonzero(hit) + rules.repeat_window, -1)
            repeated = int((np.cumsum(edge[:n]) > 0).sum())
    failed = n < rules.min_words or 100 * repeated > rules.max_repeat_percent * n
    if not raw:
        return n, word_chars, symbols, 0, repeated, True, False, None, None
    ratio = len(compressor.compress(raw)) / len(raw)
    out, bad = outside(len(raw), ratio, rules), 0
    if len(raw) > rules.chunk_bytes:
        for k in range(0, len(raw), rules.chunk_bytes):
            chunk = raw[k : k + rules.chunk_bytes]
            if outside(len(chunk), len(compressor.compress(chunk)) / len(chunk), rules):
                bad += len(chunk)
    share = bad / len(raw)
    kept = not failed and not out and share <= rules.chunk_share
    return n, word_chars, symbols, len(lines) - len(set(lines)), repeated, failed, kept, ratio, share


def quality_rules(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts, ratios and verdicts for each row of docs. No shuffle: each text is judged by itself."""

    def make():
        import zstandard

        hashes, compressor = WordHashes(), zstandard.ZstdCompressor(level=rules.level)
        names = [x.split()[0] for x in SCHEMA.split(", ")][1:]

        def each(batch):
            rows = [measure(t, rules, hashes, compressor) for t in texts(batch)]
            return {"doc_id": batch.column("doc_id"), **{c: [r[i] for r in rows] for i, c in enumerate(names)}}

        return each

    return map_rows(id_text(docs, id_col, text_col), make, SCHEMA)


def keep(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text") -> DataFrame:
    """The rows of docs whose text passes, with docs' own columns. One scan: the verdict is a column of the same row."""

    from collections.abc import Iterator

    import pyarrow as pa

    def passes(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import zstandard

        hashes, compressor = WordHashes(), zstandard.ZstdCompressor(level=rules.level)
        for column in columns:
            yield pa.array([measure(t.as_py() or "", rules, hashes, compressor)[6] for t in column], pa.bool_())

    passes.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.where(F.arrow_udf(passes, "boolean")(F.col(text_col).cast("string")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
