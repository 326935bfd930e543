"""Ranking of provisions by words and keywords, validity by date, and references."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TERM_SPLIT
from ..sources.tables import Settings


def active_on(status: Column, start: Column, end: Column, day: Column) -> Column:
    """Null status and null bounds are open; bounds belong to the range."""
    return (status.isNull() | (status == "ACTIVE")) & (start.isNull() | (start <= day)) & (end.isNull() | (end >= day))


#: Characters of provisions that one broadcast holds; a larger corpus goes in blocks, each over all texts.
BLOCK_CHARS = 32_000_000


def normalised(text: str | None) -> str:
    """NFKC, then lower case by Turkish rules."""
    return unicodedata.normalize("NFKC", text or "").replace("İ", "i").replace("I", "ı").lower()


def _terms(text: str) -> set[str]:
    return {t for t in re.split(TERM_SPLIT, text) if len(t) > 2}


class Provisions:
    """A block of the corpus as a map from term to places and weights, with its keywords of several words."""

    def __init__(self, rows: list[tuple]):
        rows = sorted(rows, key=lambda r: r[0])
        self.items = np.array([r[0] for r in rows])
        weights: dict[str, dict[int, float]] = {}
        self.phrases: dict[str, list[int]] = {}
        for k, (_, keywords, text) in enumerate(rows):
            for word in map(normalised, keywords or []):
                if " " in word:
                    self.phrases.setdefault(word, []).append(k)
                else:
                    own = weights.setdefault(word, {})
                    own[k] = own.get(k, 0.0) + 4.0
            for t in _terms(normalised(text)):
                own = weights.setdefault(t, {})
                own[k] = own.get(k, 0.0) + 1.0
        # Terms of an eighth of the items and more as rows of a matrix (so at most eight times their postings), others as places and weights.
        dense = [t for t, own in weights.items() if 8 * len(own) >= len(rows)]
        self.row = {t: j for j, t in enumerate(dense)}
        self.matrix = np.zeros((len(dense), len(rows)))
        for t, j in self.row.items():
            self.matrix[j, list(weights[t])] = list(weights[t].values())
        self.postings = {t: (np.fromiter(own, np.int64, len(own)), np.fromiter(own.values(), np.float64, len(own))) for t, own in weights.items() if t not in self.row}

    def scores(self, text: str | None) -> np.ndarray:
        """4 for each keyword that the text has (as a term, or anywhere if it has a space), 1 for each common term."""
        text = normalised(text)
        terms = _terms(text)
        out = self.matrix[[self.row[t] for t in terms & self.row.keys()]].sum(axis=0)
        hits = [self.postings[t] for t in terms & self.postings.keys()]
        if hits:
            out += np.bincount(np.concatenate([h[0] for h in hits]), weights=np.concatenate([h[1] for h in hits]), minlength=len(out))
        for phrase, places in self.phrases.items():
            if phrase in text:
                np.add.at(out, places, 4.0)
        return out

    def best(self, text: str | None, k: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The k best items with a score, ties by item, and their scores."""
        scores = self.scores(text)
        some = np.flatnonzero(scores > 0)
        some = some[np.argsort(-scores[some], kind="stable")][:k]
        return self.items[some], scores[some]


def relevance(docs: DataFrame, corpus: DataFrame, doc: str, text: str, item: str, keywords: str, words: str, k: int | None = None) -> DataFrame:
    """(doc, item, score) of items with a score above 0 for each text; with k the best k only, ties by item.

    The corpus goes in blocks of a checked size to all tasks, and a text is scored within its own row: no term is shuffled."""
    kinds = dict(docs.dtypes) | dict(corpus.dtypes)
    parts = []
    for block in _blocks(corpus, item, keywords, words):

        def run(batches, block=block):
            found = Provisions(block.value)
            for batch in batches:
                got = [found.best(t.as_py(), k) for t in batch.column(1)]
                sizes = [len(x[0]) for x in got]
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(got)), sizes)))
                items = pa.array(np.concatenate([x[0] for x in got]).tolist()) if sum(sizes) else pa.array([], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, items, pa.array(np.concatenate([x[1] for x in got]))], names=[doc, item, "score"])

        parts.append(docs.select(doc, text).mapInArrow(run, f"{doc} {kinds[doc]}, {item} {kinds[item]}, score double"))
    return reduce(DataFrame.unionByName, parts)


def _blocks(corpus: DataFrame, item: str, keywords: str, words: str) -> list:
    """The corpus as broadcasts of at most some BLOCK_CHARS characters."""
    own = corpus.select(F.col(item).alias("i"), F.col(keywords).alias("k"), F.col(words).alias("w"))
    size = own.agg(F.sum(F.length("w") + F.length(F.array_join("k", " ")))).first()[0] or 0
    n, spark = max(1, -(-size // BLOCK_CHARS)), corpus.sparkSession
    return [spark.sparkContext.broadcast([tuple(r) for r in own.where(F.pmod(F.xxhash64("i"), F.lit(n)) == b).collect()]) for b in range(n)]


def item_totals(docs: DataFrame, corpus: DataFrame, text: str, item: str, keywords: str, words: str) -> DataFrame:
    """(item, n_docs, total): texts with a score above 0 for each item, and the sum of their scores. Summed within each task, which hands on one row for each item, so no pair of text and item is a row."""
    kind, parts = dict(corpus.dtypes)[item], []
    for block in _blocks(corpus, item, keywords, words):

        def run(batches, block=block):
            found = Provisions(block.value)
            n, total = np.zeros(len(found.items), np.int64), np.zeros(len(found.items))
            for batch in batches:
                for t in batch.column(0):
                    scores = found.scores(t.as_py())
                    n += scores > 0
                    total += scores
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(found.items[some].tolist(), pa.int64() if not len(some) else None), pa.array(n[some]), pa.array(total[some])], names=[item, "n_docs", "total"])

        parts.append(docs.select(text).mapInArrow(run, f"{item} {kind}, n_docs long, total double"))
    return reduce(DataFrame.unionByName, parts).groupBy(item).agg(F.sum("n_docs").alias("n_docs"), F.sum("total").alias("total"))


def retrieve(docs: DataFrame, corpus: DataFrame, doc: str, text: str, item: str, keywords: str, words: str, valid: Column, k: int | None = None) -> DataFrame:
    """(doc, place, item, score): the k best valid provisions of each text; the first k of the whole corpus, with score 0, for a text that none matches. k is the session's result_limit, if not given."""
    k = Settings.of(docs.sparkSession).result_limit if k is None else k
    scores = relevance(docs, corpus.where(valid), doc, text, item, keywords, words, k)
    best = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col(item).alias("i")))), 1, k), lambda x: F.struct(x.i.alias("i"), (-x.s).alias("s")))
    # At most k rows of each block for a text.
    rows = docs.select(doc).join(scores.groupBy(doc).agg(best.alias("best")), doc, "left")
    first = F.array(*(F.struct(F.lit(r[0]).alias("i"), F.lit(0.0).alias("s")) for r in corpus.select(item).orderBy(item).limit(k).collect()))
    return rows.select(doc, F.posexplode(F.coalesce("best", first)).alias("place", "x")).select(doc, (F.col("place") + 1).alias("place"), F.col("x.i").alias(item), F.col("x.s").alias("score"))


# Weights of the words of titles and of texts in full-text ranks.
TITLE_WEIGHT, TEXT_WEIGHT = 1.0, 0.4


def cover_density(words: list[str], query: set[str], titles: int) -> float:
    """Sum over the shortest stretches that hold all words of the query, each by its weights and the words between. words: the first ``titles`` of them are of titles."""
    at = [(k, w) for k, w in enumerate(words) if w in query]
    total, start = 0.0, 0
    while True:
        seen: set[str] = set()
        end = next((j for j in range(start, len(at)) if seen.add(at[j][1]) or seen == query), None)
        if end is None:
            return total
        seen = set()
        begin = next(j for j in range(end, start - 1, -1) if seen.add(at[j][1]) or seen == query)
        inverse = sum(1 / (TITLE_WEIGHT if at[j][0] < titles else TEXT_WEIGHT) for j in range(begin, end + 1))
        noise = at[end][0] - at[begin][0] - (end - begin)
        total += (end - begin + 1) / inverse / (1 + noise)
        start = begin + 1


def full_text(queries: DataFrame, corpus: DataFrame, query: str, terms: str, item: str, titles: list[str], text: str, order: list[Column], k: int = 8) -> DataFrame:
    """(query, place, item, rank): provisions that hold all terms of a query, by cover density, then by order; the k best.

    Words meet by equality on the term, one row for each item and distinct word; only pairs that match in full are ranked."""
    split = lambda c: F.filter(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    own = corpus.select(F.col(item), F.concat(*map(split, titles), split(text)).alias("words"), sum((F.size(split(c)) for c in titles), F.lit(0)).alias("titles"), *(c.alias(f"_o{j}") for j, c in enumerate(order)))
    asked = queries.select(query, F.array_distinct(F.transform(terms, lambda t: F.lower(t))).alias("asked")).where(F.size("asked") > 0)
    hits = asked.select(query, F.size("asked").alias("n"), F.explode("asked").alias("term")).join(own.select(item, F.explode(F.array_distinct("words")).alias("term")), "term")
    matched = hits.groupBy(query, item).agg(F.count(F.lit(1)).alias("hits"), F.first("n").alias("n")).where("hits = n").select(query, item)

    @F.pandas_udf("double")
    def rank(words, asked, titles):
        import pandas as pd

        return pd.Series([cover_density(list(w), set(q), t) for w, q, t in zip(words, asked, titles, strict=True)], dtype="float64")

    rows = matched.join(asked, query).join(own, item).withColumn("rank", rank("words", "asked", "titles"))
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("rank"), *(F.col(f"_o{j}") for j in range(len(order))), item))
    return rows.withColumn("place", place).where(F.col("place") <= k).select(query, "place", item, "rank")


def nearest(queries: DataFrame, vectors: DataFrame, id_: str, vector: str, k: int, block: int = 8192) -> DataFrame:
    """(query, place, id, similarity): the k vectors of greatest cosine with each query, itself left out, ties by id. Exact.

    Queries go in blocks of a fixed number to all tasks; a task keeps k vectors for each query of the block, whatever it reads.
    It compares some AT_ONCE queries with as many rows at a time, so what it holds besides has a bound too."""
    n, spark = max(1, -(-queries.count() // block)), vectors.sparkSession
    parts = []
    for b in range(n):
        own = queries.where(F.pmod(F.xxhash64(id_), F.lit(n)) == b).where(F.col(vector).isNotNull()).select(id_, vector).toArrow()
        sent = spark.sparkContext.broadcast((own.column(0).to_numpy(), _unit(own.column(1))))

        def run(batches, sent=sent):
            ids, asked = sent.value
            best = np.full((len(ids), k), -np.inf), np.full((len(ids), k), -1, np.int64)
            for batch in batches:
                batch = batch.filter(batch.column(1).is_valid())
                for r in range(0, batch.num_rows if len(ids) else 0, AT_ONCE):
                    some = batch.slice(r, AT_ONCE)
                    there, units = some.column(0).to_numpy(), _unit(some.column(1))
                    for q in range(0, len(ids), AT_ONCE):
                        _keep_best(*(x[q : q + AT_ONCE] for x in best), ids[q : q + AT_ONCE], asked[q : q + AT_ONCE] @ units.T, there)
            rows, cols = np.nonzero(best[1] >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(best[1][rows, cols]), pa.array(best[0][rows, cols])], names=["query", id_, "similarity"])

        parts.append(vectors.select(id_, vector).mapInArrow(run, f"query long, {id_} long, similarity double"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), id_))
    return reduce(DataFrame.unionByName, parts).where("similarity > -2").withColumn("place", place).where(F.col("place") <= k).select("query", "place", id_, "similarity")


#: Queries, and rows, that are compared at a time.
AT_ONCE = 1024


def _keep_best(best: np.ndarray, who: np.ndarray, ids: np.ndarray, near: np.ndarray, there: np.ndarray) -> None:
    """Puts what is nearer into the k best of each query and whose they are, in place. Only rows at or above the k-th best are sorted, with their ties."""
    k = best.shape[1]
    near[ids[:, None] == there[None, :]] = -np.inf
    least = best[:, -1]
    if near.shape[1] > k:
        least = np.maximum(least, np.partition(near, -k, axis=1)[:, -k])
    i, j = np.nonzero((near >= least[:, None]) & (near > -np.inf))
    if not len(i):
        return
    rows = np.concatenate([np.repeat(np.arange(len(ids)), k), i])
    scores, owners = np.concatenate([best.ravel(), near[i, j]]), np.concatenate([who.ravel(), there[j]])
    order = np.lexsort((owners, -scores, rows))
    # The first k of each query: each has k at least.
    starts = np.searchsorted(rows[order], np.arange(len(ids)))
    first = order[starts[:, None] + np.arange(k)]
    best[:], who[:] = scores[first], owners[first]


def _unit(vectors) -> np.ndarray:
    """Rows of length 1; a zero vector stays zero."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 1))
    length = np.linalg.norm(flat, axis=1, keepdims=True)
    return flat / np.where(length > 0, length, 1.0)


def references(asked: DataFrame, context: DataFrame, keys: list[str]) -> DataFrame:
    """Asked references that the context has. Spark broadcasts the context only if it knows it to be small."""
    return asked.join(context.select(*keys).distinct(), keys, "left_semi")


def orphans(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key isn't null and that no parent has: what a foreign key would refuse."""
    return rows.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def chosen_references(asked: Column, context: Column) -> Column:
    """The asked references whose source and article the context has; the whole context if none is left. Both are a document's own short arrays of struct(source, article, title)."""
    kept = F.filter(asked, lambda r: F.exists(context, lambda c: (c.source == r.source) & (c.article == r.article)))
    return F.when(F.size(F.coalesce(kept, F.array())) > 0, kept).otherwise(context)


def version_asof(questions: DataFrame, versions: DataFrame, key: str, asked: str, since: str, bucket: str = "month") -> DataFrame:
    """questions with version: the latest version of the key at or before the asked time; null if there is none. No range join.

    Versions and questions of a key are merged in time order within a bucket of time, so a hot key is many groups; what holds at
    a bucket's begin comes from a running maximum over buckets, of which a key has few."""
    b = lambda c: F.date_trunc(bucket, F.col(c).cast("timestamp_ntz")).alias("_bucket")
    v = versions.select(F.col(key).alias("_key"), b(since), F.col(since).alias("_at"), F.col(since).alias("_version")).distinct()
    q = questions.withColumns({"_key": F.col(key), "_at": F.col(asked), "_version": F.lit(None).cast(versions.schema[since].dataType), "_bucket": b(asked), "_asked": F.lit(True)})
    held = v.groupBy("_key", "_bucket").agg(F.max("_version").alias("_last")).unionByName(q.select("_key", "_bucket").distinct().withColumn("_last", F.lit(None).cast(versions.schema[since].dataType)))
    before = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = held.groupBy("_key", "_bucket").agg(F.max("_last").alias("_last")).withColumn("_carry", F.max("_last").over(before)).select("_key", "_bucket", "_carry")
    w = Window.partitionBy("_key", "_bucket").orderBy("_at", F.col("_version").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    got = q.unionByName(v, allowMissingColumns=True).withColumn("_own", F.max("_version").over(w)).where("_asked").join(carried, ["_key", "_bucket"], "left")
    return got.select(*questions.columns, F.coalesce("_own", "_carry").alias("version"))
