"""Pages and chunks of documents, evidence on pages, and the lock between two accounting standards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X

# Caps in characters.
TEXT_CAP, CHUNK, PROMPT_CAP = 3_000_000, 110_000, 120_000
#: Least characters of a text that can be reviewed.
LEAST_TEXT = 40


def page_cap(pages: DataFrame, doc: str, page: str, text: str, cap: int = TEXT_CAP) -> DataFrame:
    """Pages before the running length first passes the cap; the first page always."""
    block = F.length(F.concat(F.lit("\n\n[REPORT PAGE "), F.col(page).cast("string"), F.lit("]\n"), F.col(text)))
    w = Window.partitionBy(doc).orderBy(page)
    rows = pages.withColumn("total", F.sum(block).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(w))
    return rows.where((F.col("total") <= cap) | (F.col("place") == 1))


def marked_text(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """One text for each document, each page after its marker."""
    rows = pages.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("page"), F.col(text).alias("text")))).alias("all"))
    return rows.select(doc, F.array_join(F.transform("all", lambda p: F.concat(F.lit("\n\n[REPORT PAGE "), p.page.cast("string"), F.lit("]\n"), p.text)), "").alias("text"))


def split_pages(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(page, body) of a marked text; what comes before the first marker is no page; of a repeated number the last body holds."""
    parts = F.split(F.col(text), r"(?=\[REPORT PAGE \d+\])")
    rows = docs.select(*keys, F.posexplode(parts).alias("pos", "part")).where(F.col("part").rlike(r"^\[REPORT PAGE \d+\]"))
    rows = rows.select(*keys, "pos", F.regexp_extract("part", X.MARKER, 1).cast("int").alias("page"), F.regexp_replace("part", r"^\[REPORT PAGE \d+\]", "").alias("body"))
    return rows.groupBy(*keys, "page").agg(F.max_by("body", "pos").alias("body"))


def greedy_chunks(sizes: Column, cap: int = CHUNK) -> Column:
    """Numbers of the chunks of pages with these sizes, in order: a page that would pass the cap opens a new chunk, unless it is its first. An array fold, for a document's own pages."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).cast("bigint").alias("held"), F.lit(0).alias("chunk"))

    def add(s: Column, n: Column) -> Column:
        opens = (s.held > 0) & (s.held + n > cap)
        chunk = F.when(opens, s.chunk + 1).otherwise(s.chunk)
        return F.struct(F.array_append(s.out, chunk).alias("out"), (F.when(opens, F.lit(0).cast("bigint")).otherwise(s.held) + n).alias("held"), chunk.alias("chunk"))

    return F.aggregate(sizes, start, add)["out"]


def fixed_chunks(text: Column, size: int = CHUNK) -> Column:
    """Slices of equal length; an empty text is one empty slice."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(text) - 1) / size)).cast("int")), lambda k: F.substring(text, (k * size + 1), F.lit(size)))


def readable(text: Column) -> Column:
    """A document's text without white space around it; null (UNREADABLE) under 40 characters."""
    bare = F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    return F.when(F.length(bare) >= LEAST_TEXT, bare)


def text_chunks(text: Column, cap: int = CHUNK) -> Column:
    """A text's chunks: itself up to the cap; slices without two page markers; else whole pages, as many as fit, what comes before the first marker with it. A null text is one empty chunk."""
    units = F.split(text, r"(?=\[REPORT PAGE \d+\])")
    of = greedy_chunks(F.transform(units, lambda u: F.length(u).cast("bigint")), cap)
    whole = F.transform(F.sequence(F.lit(0), F.array_max(of)), lambda c: F.array_join(F.filter(units, lambda u, i: F.get(of, i) == c), ""))
    marked = F.size(F.filter(units, lambda u: u.rlike(r"^\[REPORT PAGE \d+\]")))
    return F.when(F.coalesce(F.length(text), F.lit(0)) <= cap, F.array(F.coalesce(text, F.lit("")))).when(marked <= 1, fixed_chunks(text, cap)).otherwise(whole)


def marker_pages(evidence: Column, there: Column) -> Column:
    """The pages that an evidence names by marker, as far as the document has them, in order."""
    return F.array_sort(F.array_intersect(F.transform(F.regexp_extract_all(evidence, F.lit(X.MARKER), F.lit(1)), lambda p: p.try_cast("int")), there))


def anchors(evidence: Column) -> Column:
    """Distinct numbers of an evidence text that can tell a page: grouped or decimal ones, and plain ones of three digits and more but years."""
    bare = F.regexp_replace(evidence, X.CITATION, "")
    plain = F.filter(F.regexp_extract_all(bare, F.lit(r"(?<![\d.,])\d{3,}(?![\d.,])"), F.lit(0)), lambda t: ~t.rlike(r"^(19|20)\d{2}$"))
    return F.array_distinct(F.concat(F.regexp_extract_all(bare, F.lit(r"%?\d{1,3}(?:\.\d{3})+(?:,\d+)?|%?\d+,\d+"), F.lit(0)), plain))


def page_tokens(text: Column) -> Column:
    """All numbers that a bounded search finds on a page: each run of digits and separators, each part of it that starts it and ends before a separator, with and without a percent sign before. Lets evidence meet pages by an equality join."""
    runs = F.regexp_extract_all(text, F.lit(r"(?:(?<![\d.,])%)?[\d.,]+"), F.lit(0))

    def parts(run: Column) -> Column:
        core = F.regexp_replace(run, "^%", "")
        cuts = F.filter(F.sequence(F.lit(1), F.length(core)), lambda k: (k == F.length(core)) | F.substring(core, k + 1, F.lit(1)).isin(".", ","))
        own = F.transform(cuts, lambda k: F.substring(core, F.lit(1), k))
        return F.when(F.startswith(run, F.lit("%")), F.concat(own, F.transform(own, lambda t: F.concat(F.lit("%"), t)))).otherwise(own)

    return F.array_distinct(F.flatten(F.transform(runs, parts)))


def ground(evidence: DataFrame, pages: DataFrame, doc: str, item: str) -> DataFrame:
    """Pages of each evidence: those that alone hold one of its numbers, else the page with most of its numbers (the first of equals).

    evidence: doc, item, evidence; pages: doc, page, body. Numbers meet by equality on (doc, number)."""
    asked = evidence.select(doc, item, F.explode(anchors(F.col("evidence"))).alias("number"))
    there = pages.select(doc, "page", F.explode(page_tokens(F.col("body"))).alias("number")).distinct()
    hits = asked.join(there, [doc, "number"])
    by_number = hits.groupBy(doc, item, "number").agg(F.count(F.lit(1)).alias("n"), F.min("page").alias("only"))
    strong = by_number.where("n = 1").groupBy(doc, item).agg(F.array_sort(F.collect_set("only")).alias("strong"))
    votes = hits.groupBy(doc, item, "page").agg(F.count(F.lit(1)).alias("votes"))
    most = votes.groupBy(doc, item).agg(F.max_by("page", F.struct("votes", (-F.col("page")).alias("first"))).alias("page"))
    return most.join(strong, [doc, item], "left").select(doc, item, F.coalesce("strong", F.array("page")).alias("pages"))


def lock(text: Column, summary: Column) -> Column:
    """struct(money, percent): numbers only in the region of the standard that the summary didn't choose; null without two regions."""
    a, b = F.regexp_instr(text, F.lit(X.HEADER_TMS)), F.regexp_instr(text, F.lit(X.HEADER_IFRS))
    says_a, says_b = summary.rlike(X.STANDARD_TMS), summary.rlike(X.STANDARD_IFRS)
    choose_a = F.when(says_a != says_b, says_a).otherwise(a <= b)
    from_a = F.substring(text, a, F.when(b > a, b - a).otherwise(F.length(text)))
    from_b = F.substring(text, b, F.when(a > b, a - b).otherwise(F.length(text)))
    chosen, foreign = F.when(choose_a, from_a).otherwise(from_b), F.when(choose_a, from_b).otherwise(from_a)
    both = F.struct(F.array_except(N.money_tokens(foreign), N.money_tokens(chosen)).alias("money"), F.array_except(N.canonical_percents(foreign), N.canonical_percents(chosen)).alias("percent"))
    return F.when((a > 0) & (b > 0) & summary.isNotNull(), both)


def violates(text: Column, money: Column, percent: Column) -> Column:
    bare = F.translate(text, ". ", "")
    return F.coalesce(F.exists(money, lambda m: F.contains(bare, m)) | F.arrays_overlap(N.canonical_percents(text), percent), F.lit(False))


def scrub(text: Column, money: Column, percent: Column) -> Column:
    """The text without the sentences that violate the lock; the text itself if none would be left."""
    kept = F.btrim(F.array_join(F.transform(F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: ~violates(s, money, percent)), lambda s: F.btrim(s)), " "))
    return F.when(F.coalesce(kept, F.lit("")) == "", text).otherwise(kept)
