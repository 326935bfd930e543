"""Findings: severities, scores, statement rules, order and duplicates. DataFrame in, DataFrame out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X

# Statement lines in their order: label, whether it is a profit, Turkish and English name.
STATEMENT_LINES = [
    ("Esas Faaliyet Karı", True, "Esas faaliyet kârı", "Operating profit"),
    ("Dönem Karı", True, "Dönem kârı", "Net income"),
    ("Pazarlama ve satış giderleri", False, "Pazarlama ve satış giderleri", "Marketing and selling expenses"),
    ("Pazarlama giderleri", False, "Pazarlama giderleri", "Marketing expenses"),
    ("Genel yönetim giderleri", False, "Genel yönetim giderleri", "General administrative expenses"),
    ("Finansman giderleri", False, "Finansman giderleri", "Finance expenses"),
]
# Penalties, bands and the threshold of a finding in percent.
PENALTIES = {4: 45, 3: 28, 2: 8, 1: 3}
THRESHOLD = 20.0


def histogram(findings: DataFrame, *keys: str, severity: str = "severity") -> DataFrame:
    """Counts of each rank by key; map-side counts, so a frequent key costs one row from each task."""
    r = X.severity_rank(F.col(severity))
    return findings.groupBy(*keys).agg(*(F.count_if(r == k).alias(n.lower()) for n, k in X.SEVERITIES.items()))


def calibrated(critical: Column, high: Column, medium: Column, low: Column) -> Column:
    """100 less the penalties, within the band that the gravest finding sets."""
    raw = F.greatest(F.lit(0), F.least(F.lit(100), 100 - (critical * 45 + high * 28 + medium * 8 + low * 3)))
    within = lambda lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), raw))
    return F.when(critical > 0, F.least(F.lit(29), raw)).when(high > 0, within(30, 54)).when(medium > 0, within(55, 79)).otherwise(within(80, 100)).cast("int")


def change(previous: Column, current: Column) -> Column:
    return F.when(previous != 0, (current - previous) / F.abs(previous) * 100.0)


def statement_region(text: Column) -> Column:
    """The part between the first headers of two standards where both are there, else the whole text."""
    a, b = F.regexp_instr(text, F.lit(X.HEADER_TMS)), F.regexp_instr(text, F.lit(X.HEADER_IFRS))
    return F.when((a > 0) & (b > 0), F.substring(text, F.least(a, b), F.abs(a - b))).otherwise(text)


def statement_findings(docs: DataFrame, *keys: str, text: str = "text", language: str = "language") -> DataFrame:
    """Findings of the statement lines of each text, in the lines' order. One pass over the text for each line, no join."""
    en = F.lower(F.coalesce(F.col(language), F.lit(""))) == "en"
    region = statement_region(F.col(text))
    lines = []
    for seq, (label, profit, tr, english) in enumerate(STATEMENT_LINES):
        pattern = rf"(?m)^\s*\Q{label}\E\s+\(?([\d.]+,\d+)\)?\s+\(?([\d.]+,\d+)\)?"
        prev, cur = (N.tr_number(F.regexp_extract(region, pattern, k)) for k in (1, 2))
        lines.append(F.struct(F.lit(seq).alias("seq"), F.lit(profit).alias("profit"), F.when(en, english).otherwise(tr).alias("name"), prev.alias("prev"), cur.alias("cur")))
    rows = docs.select(*keys, en.alias("en"), F.explode(F.array(*lines)).alias("x")).select(*keys, "en", "x.*")
    pct = F.abs(F.col("change"))
    rows = rows.where("prev is not null and cur is not null and prev <> 0").withColumn("change", change(F.col("prev"), F.col("cur")))
    rows = rows.where(F.when(F.col("profit"), (F.col("cur") < F.col("prev")) & (pct >= THRESHOLD)).otherwise((F.col("cur") >= F.col("prev")) & (F.col("change") >= THRESHOLD)))
    p, a, b = N.formatted_percent(pct, F.col("en")), N.formatted(F.col("prev"), F.col("en")), N.formatted(F.col("cur"), F.col("en"))
    say = lambda en_text, tr_text: F.when(F.col("en"), F.concat(*en_text)).otherwise(F.concat(*tr_text))
    name, lit = F.col("name"), F.lit
    title = F.when(F.col("profit"), say((name, lit(" declined by "), p), (name, lit(" "), p, lit(" oranında düştü")))).otherwise(say((name, lit(" increased by "), p), (name, lit(" "), p, lit(" oranında arttı"))))
    told = F.when(
        F.col("profit"),
        say((name, lit(" fell from "), a, lit(" million TL to "), b, lit(" million TL, a "), p, lit(" decrease.")), (name, lit(" "), a, lit(" milyon TL'den "), b, lit(" milyon TL'ye "), p, lit(" oranında düşmüştür."))),
    ).otherwise(say((name, lit(" increased from "), a, lit(" million TL to "), b, lit(" million TL, a "), p, lit(" increase.")), (name, lit(" "), a, lit(" milyon TL'den "), b, lit(" milyon TL'ye "), p, lit(" oranında artmıştır."))))
    return rows.select(*keys, "seq", title.alias("title"), F.lit("MEDIUM").alias("severity"), told.alias("evidence"))


def dedupe_findings(findings: DataFrame, *keys: str, order: list[str], limit: int = 8) -> DataFrame:
    """Per key: the gravest first, ties in the given order; the first of each normalised title; at most limit (a feature of the report)."""
    ranked = findings.withColumn("rank", X.severity_rank(F.col("severity"))).withColumn("key", X.finding_key(F.col("title")))
    # The first of each title by a partial aggregate: a hot key never meets in one sort.
    first = ranked.groupBy(*keys, "key").agg(F.min(F.struct((-F.col("rank")).alias("r"), *order, "title", "severity")).alias("x")).select(*keys, "x.*")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("r", *order))
    return first.withColumn("place", place).where(F.col("place") <= limit).select(*keys, "place", "title", "severity", *order)


def chunk_merge(chunks: DataFrame, *keys: str, order: str, lists: dict[str, tuple[str, int, bool]]) -> DataFrame:
    """Lists of a document's chunks put together in chunk order; out name: (column, cap, distinct). Grouped by document, whose chunks are few."""
    out = []
    for name, (column, cap, distinct) in lists.items():
        whole = F.flatten(F.array_sort(F.collect_list(F.struct(order, column)))[column])
        out.append(F.slice(F.array_distinct(whole) if distinct else whole, 1, cap).alias(name))
    return chunks.groupBy(*keys).agg(*out)


def merge_reviews(chunks: DataFrame, doc: str, order: str, review: str, turkish: Column) -> DataFrame:
    """(doc, response, chunks): the reviews of a document's chunks as one.

    Risks by severity (equal ones in chunk order), the first of each title, 8 at most; 6 distinct recommendations, the first
    6 metrics, 4 distinct questions; the first summary that isn't blank; the greatest score; a rationale from the risks that
    stay. Grouped by document, whose chunks are few (a text of 3,000,000 characters has 28)."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(review).alias("r")))), lambda x: x.r)
    rows = chunks.groupBy(doc).agg(parts.alias("_r"), F.count(F.lit(1)).alias("chunks"), F.first(turkish).alias("_tr"))
    gather = lambda name: F.flatten(F.filter(F.transform("_r", lambda r: r[name]), lambda x: x.isNotNull()))
    first = lambda values, k: F.slice(values, 1, k)
    rows = rows.withColumn("_sorted", F.transform(F.array_sort(F.transform(gather("risks"), lambda r, i: F.struct((-X.severity_rank(r.severity)).alias("rank"), i.alias("i"), r.alias("r")))), lambda x: x.r))
    rows = rows.withColumn("_keys", F.transform("_sorted", lambda r: X.finding_key(r.title)))
    rows = rows.withColumn("_risks", first(F.filter("_sorted", lambda r, i: F.array_position("_keys", F.get("_keys", i)) == i + 1), 8))
    of = lambda low, high: F.size(F.filter("_risks", lambda r: X.severity_rank(r.severity).between(low, high)))
    summary = F.coalesce(F.get(F.filter(F.transform("_r", lambda r: r.summary), lambda x: F.btrim(x) != ""), F.lit(0)), F.lit(""))
    return rows.select(doc, "chunks", F.struct(
        F.coalesce(F.array_max(F.transform("_r", lambda r: r.risk_score)), F.lit(0)).alias("risk_score"), X.rationale(of(3, 4), of(2, 2), F.col("_tr")).alias("score_rationale"), summary.alias("summary"), F.col("_risks").alias("risks"),
        first(F.array_distinct(gather("recommendations")), 6).alias("recommendations"), first(gather("key_metrics"), 6).alias("key_metrics"), first(F.array_distinct(gather("advisor_questions")), 4).alias("advisor_questions"),
        F.slice(F.get("_r", F.lit(0)).references, 1, 0).alias("references"),
    ).alias("response"))


def duplicate_metrics(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Equal labels; or equal percentages and a common label word; or amounts of 100,000 and more within 2 %."""
    same = (a["label"] != "") & (a["label"] == b["label"])
    percents = (F.size(a["percents"]) > 0) & (F.array_sort(a["percents"]) == F.array_sort(b["percents"])) & X.shares_token(a["label"], b["label"])
    large = (a["magnitude"] >= 100000) & (b["magnitude"] >= 100000) & (F.abs(a["magnitude"] - b["magnitude"]) / F.greatest(a["magnitude"], b["magnitude"]) <= 0.02)
    return same | percents | large


def dedupe_metrics(metrics: Column) -> Column:
    """Greedy, in order, over array<struct<label,percents,magnitude,digits,value>>: a duplicate of a kept one replaces it in place if it has more digits. Lists are short (six at most in a review)."""
    view = lambda m: {c: m[c] for c in ("label", "percents", "magnitude")}

    def add(kept: Column, m: Column) -> Column:
        hits = F.filter(F.sequence(F.lit(0), F.size(kept) - 1), lambda i: duplicate_metrics(view(F.get(kept, i)), view(m)))
        at = F.when(F.size(kept) > 0, F.get(hits, F.lit(0)))
        return F.when(at.isNull(), F.array_append(kept, m)).otherwise(F.transform(kept, lambda k, i: F.when((i == at) & (m["digits"] > k["digits"]), m).otherwise(k)))

    return F.aggregate(metrics, F.slice(metrics, 1, 0), add)
