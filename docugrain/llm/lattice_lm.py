"""Language-model scores by subword lattice likelihood.

Method: an existing subword vocabulary (a sentencepiece file) gives pieces and scores. A word's probability is the sum
over all its segmentations into pieces of the product of the pieces' probabilities, by forward recursion in log space.
Piece probabilities start from the file's scores (rank r has weight 1 / (r + 10)) and are weighed with the expected
counts that the training words' lattices give, each as often as the word occurs (one forward-backward pass; the scores
count as ``prior`` pieces). All words, seen ones too, are scored by that lattice alone; after each piece a word stops or
goes on, and a text is its words and one end, each token being an end as often as in training. Base counts are separate.

The query's model (``FITTED``) goes further. Each training word is a piece too, which spans the whole word: of its count it keeps
what absolute discounting leaves it, and the rest of all is shared by the segmentations into the file's pieces, fitted in two
passes to the training words, each counted once. And a text draws its words from an urn to which each word drawn adds one
like it, so words of a text's own language and subject become likelier; the order of words plays no part in it.

Many words are worked on at once: rows of code points by length, pieces looked up by the 64-bit hash of each window.

Counts go over all training documents: per task, then by a shuffle on the word. The most frequent words (at most
``head`` of at most ``head_chars`` characters) are broadcast; all others are joined on the word, a join that can be split. So
no task meets all rows of a frequent word, and what is broadcast has a bound.

Defined results: null, empty or blank text is one end token; each row of the input has its own row, whatever its doc_id,
and equal texts score alike; rows without doc_id belong to training; with no training document all words are unknown and the file's scores alone count;
a character that no piece has is spelled in bytes; any length of text or word is read whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, cut, free, id_text, table, texts

VOCABULARY = "piece_bpe_32k.model"
START = "▁"


@dataclass(frozen=True)
class Model:
    vocabulary: str = VOCABULARY
    #: Documents with crc32(doc_id as text) % folds = 0 are held out.
    folds: int = 10
    head: int = 200_000
    head_chars: int = 100
    prior: float = 1000.0
    #: Forward-backward passes over the training words.
    passes: int = 1
    #: Whether each training word is a piece of its own too, spanning the whole word.
    whole: bool = False
    #: How many words the corpus weighs in a text's urn, to which each word that is drawn adds one of its own; without it words don't depend on each other.
    urn: float | None = None
    #: Words that a task counts before it hands its counts on; it bounds memory only.
    flush: int = 300_000


def pieces(name: str) -> tuple[list[str], list[float]]:
    """The file's pieces and their weights from its scores; bytes are named <0xNN>."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    names, weights = [], []
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i):
            continue
        names.append(sp.id_to_piece(i))
        # Bytes have score 0 in the file though they are the last resort: they rank after all pieces.
        weights.append(1 / (10 + (sp.get_piece_size() if sp.is_byte(i) else -sp.get_score(i))))
    return names, weights


#: What the query scores with: training words as pieces of their own, the file's pieces fitted in two passes, words of a text that draw each other.
FITTED = Model(passes=2, whole=True, urn=2000.0)


class Lattice:
    """Pieces with log probabilities, and the recursions over many words at once. Arrays have a row for each place and a column for each word."""

    BASE = U64(0x9E3779B97F4A7C15)
    #: Places times words that are worked on together; it bounds memory only.
    AREA = 1 << 16

    def __init__(self, names: list[str], weights: list[float], counts: dict[int, float], words: float, prior: float):
        total = sum(counts.values()) + prior
        # After each piece a word stops or goes on: words over pieces as counted, one in three by the prior.
        stops = (words + prior / 3) / total
        self.stop = math.log(stops / (1 + stops))
        raw = np.array([counts.get(k, 0.0) for k in range(len(names))]) + prior * np.array(weights) / sum(weights)
        self.logs = np.log(raw / total / (1 + stops))
        self.bytes = np.zeros(256, np.int64)
        by_length: dict[int, list[int]] = {}
        for k, name in enumerate(names):
            if len(name) == 6 and name.startswith("<0x"):
                self.bytes[int(name[3:5], 16)] = k
            else:
                by_length.setdefault(len(name), []).append(k)
        self.tables = {}
        for n, own in by_length.items():
            codes = np.frombuffer("".join(names[k] for k in own).encode("utf-32-le"), np.uint32).reshape(-1, n).T
            hashes = self.extend(None, codes, 1)
            for k in range(2, n + 1):
                hashes = self.extend(hashes, codes, k)
            order = np.argsort(hashes[0])
            self.tables[n] = hashes[0][order], np.array(own)[order]
        self.longest = max(by_length, default=1)

    def extend(self, shorter: np.ndarray | None, codes: np.ndarray, n: int) -> np.ndarray:
        """Hashes of all windows of n characters from those of n - 1."""
        last = codes[n - 1 :].astype(U64) + U64(1)
        return last if shorter is None else shorter[:-1] * self.BASE + last

    def groups(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(which words, code points after START padded with 0, lengths), words of like length together."""
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        order, at = np.argsort(lengths, kind="stable"), 0
        while at < len(order):
            area = np.arange(1, len(order) - at + 1) * lengths[order[at:]]
            some = order[at : at + max(1, int(np.searchsorted(area, self.AREA, "right")))]
            own = lengths[some]
            codes = np.zeros((len(some), int(own[-1])), np.uint32)
            codes[np.arange(codes.shape[1]) < own[:, None]] = np.frombuffer("".join(START + words[k] for k in some).encode("utf-32-le"), np.uint32)
            yield some, np.ascontiguousarray(codes.T), own
            at += len(some)

    def arcs(self, codes: np.ndarray, lengths: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(characters, pieces, log probabilities) by place and word; piece -1 and -inf where there is none, -2 for characters spelled in bytes."""
        out, hashes = [], None
        for n in range(1, min(self.longest, len(codes)) + 1):
            hashes = self.extend(hashes, codes, n)
            known, ids = self.tables.get(n, (np.zeros(0, U64), np.zeros(0, np.int64)))
            inside = np.arange(len(hashes))[:, None] + n <= lengths
            if len(known):
                place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                own = np.where((known[place] == hashes) & inside, ids[place], -1)
            else:
                own = np.full(hashes.shape, -1)
            p = np.where(own >= 0, self.logs[own], -np.inf)
            if n == 1 and (spelled := inside & (own < 0)).any():
                own[spelled] = -2
                chars, where = np.unique(codes[spelled], return_inverse=True)
                p[spelled] = np.array([self.logs[self.spell(c)].sum() for c in chars])[where]
            out.append((n, own, p))
        return out

    def spell(self, code: int) -> np.ndarray:
        return self.bytes[np.frombuffer(chr(code).encode(), np.uint8)]

    @staticmethod
    def forward(arcs: list, places: int, words: int) -> np.ndarray:
        alpha = np.full((places + 1, words), -np.inf)
        alpha[0] = 0.0
        steps = [(n, p, (own != -1).any(axis=1)) for n, own, p in arcs]
        for i in range(places):
            for n, p, any_ in steps:
                if i < len(p) and any_[i]:
                    np.logaddexp(alpha[i + n], alpha[i] + p[i], out=alpha[i + n])
        return alpha

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """Natural logarithm of each word's probability over all segmentations."""
        out = np.empty(len(words))
        for some, codes, lengths in self.groups(words):
            alpha = self.forward(self.arcs(codes, lengths), *codes.shape)
            out[some] = alpha[lengths, np.arange(len(some))] + self.stop
        return out

    def expect(self, words: list[str], times: np.ndarray) -> np.ndarray:
        """Expected number of each piece in the words, each word so many times."""
        into = np.zeros(len(self.logs))
        for some, codes, lengths in self.groups(words):
            arcs = self.arcs(codes, lengths)
            (places, n_words), each = codes.shape, np.arange(len(some))
            alpha = self.forward(arcs, places, n_words)
            beta = np.full((places + 1, n_words), -np.inf)
            beta[lengths, each] = 0.0
            steps = [(n, p, (own != -1).any(axis=1)) for n, own, p in arcs]
            for i in range(places - 1, -1, -1):
                for n, p, any_ in steps:
                    if i < len(p) and any_[i]:
                        np.logaddexp(beta[i], beta[i + n] + p[i], out=beta[i])
            whole = alpha[lengths, each]
            for n, own, p in arcs:
                hit = own != -1
                share = (np.exp(alpha[: len(p)] + p + beta[n:] - whole) * times[some])[hit]
                ids = own[hit]
                into += np.bincount(ids[ids >= 0], weights=share[ids >= 0], minlength=len(into))
                if n == 1 and (ids == -2).any():
                    chars, where = np.unique(codes[hit][ids == -2], return_inverse=True)
                    for c, t in zip(chars, np.bincount(where, weights=share[ids == -2]), strict=True):
                        np.add.at(into, self.spell(c), t)
        return into


#: Factors of a rising factorial that are multiplied one by one; the rest comes from Stirling's series, then exact to some 13 digits.
ONE_BY_ONE = 64


def _stirling(z, log):
    return (z - 0.5) * log(z) - z + 1 / (12 * z) - 1 / (360 * z * z * z)


def rising(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log10 of 10^x (10^x + 1) ... (10^x + n - 1). The first factor may be too small for a number, so x is its logarithm."""
    x0, few = 10.0**x, np.minimum(n, ONE_BY_ONE) - 1
    at = np.repeat(np.arange(len(x)), few)
    out = np.bincount(at, np.log(x0[at] + (np.arange(1, len(at) + 1) - (np.cumsum(few) - few)[at])), len(x)).astype(float)
    many = n > ONE_BY_ONE
    out[many] += _stirling(x0[many] + n[many], np.log) - _stirling(x0[many] + ONE_BY_ONE, np.log)
    return x + out / math.log(10)


def rising_column(x: Column, n: Column) -> Column:
    """The same of columns."""
    x0 = F.pow(F.lit(10.0), x)
    first = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(ONE_BY_ONE)) - 1), F.lit(0.0), lambda s, j: s + F.ln(x0 + j))
    rest = F.when(n > ONE_BY_ONE, _stirling(x0 + n, F.ln) - _stirling(x0 + ONE_BY_ONE, F.ln)).otherwise(0.0)
    return x + F.when(n == 1, 0.0).otherwise(first + rest) / math.log(10)


def _held_out(how: Model):
    return F.crc32(F.col("doc_id").cast("string")) % how.folds == 0


def count_words(docs: DataFrame, how: Model) -> DataFrame:
    """(word, c, n): its count in training and in all documents. docs: doc_id, text."""
    schema = pa.schema([("word", pa.string()), ("c", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train: Counter = Counter()
        held: Counter = Counter()

        def rows():
            words = list(train.keys() | held.keys())
            c = [train[w] for w in words]
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words], pa.string()), pa.array(c, pa.int64()), pa.array([a + held[w] for a, w in zip(c, words, strict=True)], pa.int64())], schema=schema)

        for batch in batches:
            for out, text in zip(batch.column("held_out").to_pylist(), texts(batch), strict=True):
                (held if out else train).update(text.encode().lower().split())
                if len(train) + len(held) > how.flush:
                    yield from rows()
                    train.clear()
                    held.clear()
        if train or held:
            yield from rows()

    parts = docs.select("text", F.coalesce(_held_out(how), F.lit(False)).alias("held_out")).mapInArrow(run, "word string, c long, n long")
    return parts.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def score(docs: DataFrame, how: Model = Model(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row for each row of docs."""
    mine = id_text(docs, id_col, text_col)
    spark = docs.sparkSession
    vocab = cut(count_words(mine, how), "words")
    words, frequent_words = F.col("c") > 0, F.char_length("word") <= how.head_chars
    one = vocab.agg(F.sum("c"), F.count_if(words), *(F.count_if(frequent_words & (F.col("n") >= 2**k)) for k in range(63)), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    ends = mine.agg(F.count_if(~F.coalesce(_held_out(how), F.lit(False)))).first()[0]
    total, distinct = (one[0] or 0) + ends, one[1] + (1 if ends else 0)
    # The least power of two that at most ``head`` words reach.
    frequent = frequent_words & (F.col("n") >= next(2**k for k in range(63) if one[2 + k] <= how.head))
    names, weights = pieces(how.vocabulary)
    start = spark.sparkContext.broadcast((names, weights))
    # What a training word's own piece leaves to its segmentations, from words seen once and twice; without such pieces all is left.
    left = (one[-2] + 1) / (one[-2] + 2 * one[-1] + 2) if how.whole else None
    spelled = min(1.0, left * one[1] / one[0]) if how.whole and one[0] else 1.0

    def expectations(batches: Iterator[pa.RecordBatch], learnt) -> Iterator[pa.RecordBatch]:
        n, counts = learnt.value
        lattice, into, words = Lattice(*start.value, counts, n, how.prior), None, 0
        for batch in batches:
            times = batch.column("c").to_numpy()
            times = np.ones_like(times) if how.whole else times
            own = lattice.expect(batch.column("word").to_pylist(), times)
            into, words = own if into is None else into + own, words + int(times.sum())
        if into is not None:
            hit = np.flatnonzero(into)
            yield pa.RecordBatch.from_arrays([pa.array([-1, *hit], pa.int32()), pa.array([float(words), *into[hit]], pa.float64())], names=["piece", "n"])

    learnt = spark.sparkContext.broadcast((0.0, {}))
    for _ in range(how.passes):
        # At most one row for each piece of the vocabulary file comes to the driver.
        got = dict(vocab.where("c > 0").select("word", "c").mapInArrow(partial(expectations, learnt=learnt), "piece int, n double").groupBy("piece").agg(F.sum("n")).collect())
        learnt = spark.sparkContext.broadcast((got.pop(-1, 0.0), got))
    under = total + 0.1 * (distinct + 1)
    end = (ends + 0.5) / (total + 1)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = learnt.value
        lattice = Lattice(*start.value, counts, words, how.prior)
        for batch in batches:
            own, c = lattice.log_probabilities(batch.column("word").to_pylist()), batch.column("c").to_numpy()
            if how.whole:
                seen = c > 0
                own += math.log(spelled)
                own[seen] = np.logaddexp(own[seen], np.log((c[seen] - left) / one[0]))
            own = (own + (math.log1p(-end) if how.urn is None else math.log(how.urn))) / math.log(10)
            base = np.log10((c + 0.1) / under)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), batch.column("n"), pa.array(base), pa.array(own)], names=["word", "c", "n", "base", "own"])

    rated = cut(vocab.mapInArrow(scored, "word string, c long, n long, base double, own double"), "rated")
    free(vocab)
    stay = math.log1p(-end) / math.log(10)
    end_base, end_own = math.log10(((ends or 0) + 0.1) / under), math.log10(end)
    most = rated.where(frequent).select("word", (F.col("c") > 0).cast("long").alias("seen"), "base", "own").toArrow()
    head = spark.sparkContext.broadcast((most.column("word").to_pylist(), np.stack([most.column(c).to_numpy().astype(float) for c in ("seen", "base", "own")], axis=1)))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, values = head.value
        place = {w.encode(): k for k, w in enumerate(listed)}.get
        for batch in batches:
            rows, words, times, sums = [], [], [], []
            for i, text in zip(batch.column("row").to_pylist(), texts(batch), strict=True):
                counts = Counter(text.encode().lower().split())
                at = np.fromiter((place(w, -1) for w in counts), np.int64, len(counts))
                n = np.fromiter(counts.values(), np.int64, len(counts))
                known = at >= 0
                seen, base, own = n[known] @ values[at[known]]
                if how.urn is not None:
                    # The urn's own content grows by one with each word; what a word weighs there is in its column.
                    every = n.sum(keepdims=True)
                    own = rising(values[at[known], 2], n[known]).sum() + ((every * stay - rising(np.array([math.log10(how.urn)]), every))[0] if len(n) else 0.0)
                sums.append((int(n.sum()) + 1, seen, base, own))
                if not known.all():
                    own = list(counts)
                    rare = np.flatnonzero(~known).tolist()
                    words += [own[k].decode() for k in rare]
                    times += n[rare].tolist()
                    rows += [i] * len(rare)
            m = len(rows)
            none = pa.nulls(m, pa.int64())
            tokens, seen, base, own = (np.array(x) for x in zip(*sums, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([batch.column("row"), pa.array(rows, pa.int64())]), pa.concat_arrays([batch.column("doc_id"), none]), pa.concat_arrays([pa.nulls(len(sums), pa.string()), pa.array(words, pa.string())]),
                 pa.array([0] * len(sums) + times, pa.int32()), pa.array([*tokens.tolist(), *[0] * m], pa.int64()), pa.array([*(seen + (ends > 0)).astype(np.int64).tolist(), *[0] * m], pa.int64()),
                 pa.array([*(base + end_base).tolist(), *[0.0] * m], pa.float64()), pa.array([*(own + end_own).tolist(), *[0.0] * m], pa.float64())],
                names=["row", "doc_id", "word", "times", "tokens", "known", "base", "own"],
            )

    # A number for each row: written here with the row, so that it is the same for all that reads it.
    numbered = mine.withColumn("row", F.monotonically_increasing_id())
    looked = cut(numbered.mapInArrow(look, "row long, doc_id long, word string, times int, tokens long, known long, base double, own double"), "looked")
    rare = rated.where(~frequent).select("word", "c", F.col("base").alias("wb"), F.col("own").alias("ws"))
    tail = looked.where("word is not null").select("row", "word", "times").join(rare, "word")
    own = F.col("times") * F.col("ws") if how.urn is None else rising_column(F.col("ws"), F.col("times"))
    tail = tail.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("tokens"), F.when(F.col("c") > 0, F.col("times").cast("long")).otherwise(0).alias("known"), (F.col("times") * F.col("wb")).alias("base"), own.alias("own"))
    sums = looked.where("word is null").select("row", "doc_id", "tokens", "known", "base", "own").unionByName(tail).groupBy("row").agg(F.max("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("tokens", "known", "base", "own")))
    return sums.select("doc_id", F.coalesce(_held_out(how), F.lit(False)).alias("held_out"), F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("own").alias("score"))


def op4_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), FITTED)
