"""Full-text search with the syntax of web search engines, over positional postings.

A query is words, "phrases", ``or`` and -words. Words side by side must all be there; ``or`` parts alternatives, each of what stands
between two of them; a minus before a word or phrase excludes what holds it. A word that falls into several terms is a phrase of them.

Terms of queries and postings (term, item, pos) meet by equality; a phrase is where its terms' positions less their places in it agree. So no
text is gone through for a query that doesn't match, and postings can be kept as a table and used again."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import Settings
from .corpus import TEXT_WEIGHT, TITLE_WEIGHT, active_on

OPERANDS = T.ArrayType(T.StructType([T.StructField("alternative", T.IntegerType()), T.StructField("excluded", T.BooleanType()), T.StructField("terms", T.ArrayType(T.StringType()))]))


def terms_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def parse(query: str | None) -> list[tuple[int, bool, list[str]]]:
    """(alternative, excluded, terms) of each operand. ``or`` parts alternatives only between operands, else it is a word; an unclosed quote goes to the end."""
    out: list[tuple[int, bool, list[str]]] = []
    alternative = opened = 0
    for m in re.finditer(r'(?P<minus>-)?(?:"(?P<phrase>[^"]*)(?:"|$)|(?P<word>[^\s"]+))', query or ""):
        word = m["word"]
        if word and word.lower() == "or" and not m["minus"] and opened and (query or "")[m.end() :].strip():
            alternative, opened = alternative + 1, 0
            continue
        terms = terms_of(m["phrase"] if word is None else word)
        if terms:
            out.append((alternative, bool(m["minus"]), terms))
            opened += 1
    return out


@F.pandas_udf(OPERANDS)
def parsed(queries: pd.Series) -> pd.Series:
    return pd.Series([[{"alternative": a, "excluded": x, "terms": t} for a, x, t in parse(q)] for q in queries])


def postings(items: DataFrame, item: str, titles: list[str], text: str) -> DataFrame:
    """(term, item, pos, title): every term of every item, those of titles before those of the text."""
    split = lambda c: F.filter(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    words = F.concat(*map(split, titles), split(text))
    rows = items.select(item, sum((F.size(split(c)) for c in titles), F.lit(0)).alias("titles"), F.posexplode(words).alias("pos", "term"))
    return rows.select("term", item, "pos", (F.col("pos") < F.col("titles")).alias("title"))


def cover_density(words: list[tuple[int, str, bool]], alternatives: list[list[list[str]]]) -> float:
    """Sum over the shortest stretches of words (pos, term, of a title) that satisfy an alternative (phrases that must all be in it), each by its words' weights and what lies between."""
    words = sorted(words)
    at = {p: w for p, w, _ in words}
    phrases = sorted({tuple(p) for a in alternatives for p in a})
    number = {p: k for k, p in enumerate(phrases)}
    asked = [{number[tuple(p)] for p in a} for a in alternatives]
    # Occurrences of phrases by their first and by their last word.
    begins, ends = {}, {}
    for k, p in enumerate(phrases):
        for pos, w, _ in words:
            if w == p[0] and all(at.get(pos + j) == p[j] for j in range(1, len(p))):
                begins.setdefault(pos, []).append((k, pos + len(p) - 1))
                ends.setdefault(pos + len(p) - 1, []).append((k, pos))
    there, total, first = [0] * len(phrases), 0.0, 0
    satisfied = lambda: any(all(there[k] for k in a) for a in asked)
    for last, (pos, _, _) in enumerate(words):
        for k, start in ends.get(pos, ()):
            there[k] += start >= words[first][0]
        if not satisfied():
            continue
        while True:  # the begin goes on as long as the stretch satisfies
            own = [k for k, end in begins.get(words[first][0], ()) if end <= pos]
            for k in own:
                there[k] -= 1
            first += 1
            if not satisfied():
                break
        stretch = words[first - 1 : last + 1]
        inverse = sum(1 / (TITLE_WEIGHT if title else TEXT_WEIGHT) for _, _, title in stretch)
        total += len(stretch) / inverse / (1 + stretch[-1][0] - stretch[0][0] - (len(stretch) - 1))
    return total


@F.pandas_udf(T.DoubleType())
def _rank(words: pd.Series, alternatives: pd.Series) -> pd.Series:
    # Nine digits: the order of a sum doesn't part equal ranks.
    return pd.Series([round(cover_density([(w["pos"], w["term"], w["title"]) for w in ws], [[list(p) for p in a] for a in al]), 9) for ws, al in zip(words, alternatives, strict=True)], dtype="float64")


def search(queries: DataFrame, query: str, asked: str, posted: DataFrame, items: DataFrame, item: str, order: list[Column], k: int = 8) -> DataFrame:
    """(query, place, item, rank): items that satisfy a query, by cover density, then ``order`` (columns of items), then item; the k best.

    posted: postings of a corpus, of which items are those that may be found. A query without terms finds nothing; nor does
    an alternative that only excludes: it names no item to look for."""
    operands = queries.select(F.col(query).alias("_q"), F.posexplode(parsed(F.col(asked))).alias("_n", "o")).select("_q", "_n", "o.*")
    allowed = items.select(F.col(item).alias("_i"), *(c.alias(f"_o{j}") for j, c in enumerate(order)))
    place = operands.select("_q", "_n", "alternative", "excluded", F.size("terms").alias("_size"), F.posexplode("terms").alias("_at", "term"))
    met = place.join(posted.select("term", F.col(item).alias("_i"), "pos"), "term")
    # An operand is in an item where all of its terms have one start. A single term has as many as there are.
    single = met.where("_size = 1").select("_q", "_n", "alternative", "excluded", "_i").distinct()
    starts = met.where("_size > 1").groupBy("_q", "_n", "alternative", "excluded", "_i", (F.col("pos") - F.col("_at")).alias("_start")).agg(F.count(F.lit(1)).alias("c"), F.first("_size").alias("_size"))
    found = single.union(starts.where("c = _size").select(single.columns).distinct())
    counts = operands.groupBy("_q", "alternative").agg(F.count_if(~F.col("excluded")).alias("_needed"))
    holding = found.groupBy("_q", "alternative", "_i").agg(F.count_if(~F.col("excluded")).alias("c"), F.count_if("excluded").alias("x"))
    full = holding.join(counts, ["_q", "alternative"]).where("_needed > 0 and c = _needed and x = 0").select("_q", "alternative", "_i")
    matched = full.join(allowed.select("_i"), "_i", "left_semi")
    # Ranks, by all places of the terms that the satisfied alternatives ask for.
    wanted = matched.join(operands.where("not excluded"), ["_q", "alternative"]).groupBy("_q", "_i", "alternative").agg(F.collect_list("terms").alias("phrases"))
    by_pair = wanted.groupBy("_q", "_i").agg(F.collect_list("phrases").alias("alternatives"))
    terms = by_pair.select("_q", "_i", F.explode(F.array_distinct(F.flatten(F.flatten("alternatives")))).alias("term"))
    words = terms.join(posted.select("term", F.col(item).alias("_i"), "pos", "title"), ["term", "_i"]).groupBy("_q", "_i").agg(F.collect_list(F.struct("pos", "term", "title")).alias("words"))
    ranked = by_pair.join(words, ["_q", "_i"]).withColumn("rank", _rank("words", "alternatives"))
    w = Window.partitionBy("_q").orderBy(F.desc("rank"), *(F.col(f"_o{j}") for j in range(len(order))), "_i")
    best = ranked.select("_q", "_i", "rank").join(allowed, "_i").withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    return best.select(F.col("_q").alias(query), "place", F.col("_i").alias(item), "rank")


def regulations(queries: DataFrame, query: str, asked: str, provisions: DataFrame, day: Column, k: int | None = None) -> DataFrame:
    """Valid provisions for each query: active, in force on the day; by rank, verified ones first, then the latest, those without a date last. As many as the session's result_limit, if k isn't given."""
    k = Settings.of(queries.sparkSession).result_limit if k is None else k
    valid = provisions.where(active_on(F.col("status"), F.col("effective_from"), F.col("effective_to"), day) & (F.col("status") == "ACTIVE"))
    order = [~F.coalesce(F.col("verified"), F.lit(False)), F.coalesce(-F.unix_date("effective_from"), F.lit(1 << 30))]
    return search(queries, query, asked, postings(valid, "id", ["title"], "text"), valid, "id", order, k)
