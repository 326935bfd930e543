"""A document's review from end to end, in the reference's order: chunks, reviewer, merge, rules, lock, direction, pages, references, score, metrics, note."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..operators import corpus, findings, pages, reviewer
from ..sources.tables import REVIEW

RISKS = "array<struct<title:string,severity:string,finding:string,evidence:string>>"
REFERENCES = "array<struct<source:string,article:string,title:string>>"


def _metrics(cards: Column, money: Column, percent: Column) -> Column:
    """Cards that don't violate the lock, with clean values, without duplicates."""
    told = lambda m: F.concat_ws(" ", *(F.coalesce(m[c], F.lit("")) for c in ("label", "value", "note")))
    clean = F.transform(F.filter(cards, lambda m: ~pages.violates(told(m), money, percent)), lambda m: F.struct(m.label.alias("card"), N.clean_metric(m.value).alias("value"), m.note.alias("note")))
    v = lambda m: F.coalesce(m.value, F.lit(""))
    seen = F.transform(clean, lambda m: F.struct(X.canon_label(m.card).alias("label"), N.canonical_percents(v(m)).alias("percents"), N.magnitude(v(m)).alias("magnitude"), N.precision_digits(v(m)).alias("digits"), m.alias("m")))
    return F.transform(findings.dedupe_metrics(seen), lambda x: F.struct(x.m.card.alias("label"), x.m.value.alias("value"), x.m.note.alias("note")))


def post_process(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """doc and review from (doc, text, language, response, context): what the rules make of a reviewer's response.

    context is the array of references that retrieval gave, empty or null without. Findings of the statement rules, if there
    are any, replace the reviewer's; those that violate the lock or their own direction go; evidence gets the pages that hold
    its numbers, else those it names by marker and the document has; the score follows from the findings that are left. A
    response without a rationale gets one from its findings. Joins are on the document; its findings and pages are few."""
    r = F.col("response")
    locked = docs.withColumns({"_lock": pages.lock(F.col("text"), r.summary), "_tr": F.coalesce(F.lower("language") == "tr", F.lit(False))})
    locked = locked.withColumns({"_money": F.col("_lock.money"), "_percent": F.col("_lock.percent")})
    ruled = findings.statement_findings(docs, doc).groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("seq", "title", "severity", F.col("evidence").alias("finding"), "evidence"))).alias("_ruled"))
    own = F.transform(F.coalesce(r.risks, F.array().cast(RISKS)), lambda x, i: F.struct(i.alias("seq"), x.title.alias("title"), x.severity.alias("severity"), x.finding.alias("finding"), x.evidence.alias("evidence")))
    found = locked.join(ruled, doc, "left").select(doc, "_money", "_percent", "_tr", F.explode(F.coalesce("_ruled", own)).alias("x")).select(doc, "_money", "_percent", "_tr", "x.*")
    kept = found.where(~pages.violates(F.col("evidence"), F.col("_money"), F.col("_percent")) & ~X.contradicts_direction(F.col("title"), F.col("evidence"))).drop("_money", "_percent")
    bodies = pages.split_pages(docs, doc)
    there = bodies.groupBy(doc).agg(F.collect_set("page").alias("_there"))
    grounded = kept.join(pages.ground(kept, bodies, doc, "seq"), [doc, "seq"], "left").join(there, doc, "left")
    named = pages.marker_pages(F.col("evidence"), F.coalesce("_there", F.array().cast("array<int>")))
    grounded = grounded.withColumn("pages", F.coalesce("pages", F.when(F.size(F.coalesce(named, F.array())) > 0, named)))
    cited = F.when(F.col("pages").isNull(), X.strip_markers(F.col("evidence"))).otherwise(X.rewrite_citation(F.col("evidence"), F.col("pages"), F.col("_tr")))
    rank = X.severity_rank(F.col("severity"))
    per = grounded.select(doc, "seq", "title", "severity", "finding", cited.alias("evidence"), "pages").groupBy(doc).agg(
        *(F.count_if(rank == k).alias(n.lower()) for n, k in X.SEVERITIES.items()),
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "title", "severity", "finding", "evidence"))), lambda s: F.struct(s.title.alias("title"), s.severity.alias("severity"), s.finding.alias("finding"), s.evidence.alias("evidence"))).alias("_risks"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("pages", F.array().cast("array<int>")))))).alias("_pages"),
    )
    out = locked.join(per, doc, "left")
    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("critical", "high", "medium", "low")}
    word = F.when(F.col("_tr"), "Rapor Sayfa ").otherwise("Report Page ")
    from_pages = F.transform("_pages", lambda p: F.struct(F.concat(word, p.cast("string")).alias("source"), F.lit("").alias("article"), F.lit("").alias("title")))
    asked = F.coalesce(r.references, F.array().cast(REFERENCES))
    references = F.when(F.size(F.coalesce("context", F.array().cast(REFERENCES))) > 0, corpus.chosen_references(asked, F.col("context"))).when(F.size(F.coalesce("_pages", F.array().cast("array<int>"))) > 0, from_pages).otherwise(asked)
    scrubbed = lambda c: F.when(F.col("_lock").isNull(), c).otherwise(pages.scrub(c, F.col("_money"), F.col("_percent")))
    return out.select(doc, F.struct(
        findings.calibrated(**n).alias("risk_score"), F.coalesce(scrubbed(r.score_rationale), X.rationale(n["critical"] + n["high"], n["medium"], F.col("_tr"))).alias("score_rationale"), scrubbed(r.summary).alias("summary"),
        F.coalesce("_risks", F.array().cast(RISKS)).alias("risks"), r.recommendations.alias("recommendations"), _metrics(r.key_metrics, F.col("_money"), F.col("_percent")).alias("key_metrics"),
        F.filter(r.advisor_questions, lambda q: ~pages.violates(q, F.col("_money"), F.col("_percent"))).alias("advisor_questions"), references.alias("references"),
    ).alias("review"))


def audit(docs: DataFrame, doc: str = "doc", call: Callable[[str], str] = reviewer.offline, chunk: int = pages.CHUNK, merge: Callable[[str], str] = reviewer.no_synthesis, cap: int = pages.PROMPT_CAP) -> DataFrame:
    """doc and review from (doc, text, language, document_type, context, total_pages, included_pages): each chunk goes to the reviewer once, their reviews are merged and post-processed; summaries of several chunks go to ``merge``, and the text gets a note before its summary.

    Chunks and responses of a document are few: a text is capped at 3,000,000 characters."""
    docs = docs.withColumn("_chunks", pages.text_chunks(F.col("text"), chunk))
    parts = docs.select(doc, "language", "document_type", F.coalesce("context", F.array().cast(REFERENCES)).alias("context"), F.posexplode("_chunks").alias("seq", "text"))
    told = reviewer.review(reviewer.prompts(parts, doc, "seq", "language", context="context"), doc, "seq", "language", call=call)
    tr = F.coalesce(F.lower("language") == "tr", F.lit(False))
    whole = reviewer.synthesize(told.select(doc, "seq", "language", F.col("review.summary").alias("summary"), tr.alias("tr")), doc, "seq", "summary", "tr", merge, cap)
    merged = findings.merge_reviews(told, doc, "seq", "review", tr).join(whole, doc, "left").select(doc, "chunks", F.col("response").withField("summary", F.coalesce("summary", F.lit(""))).alias("response"))
    single = told.where("seq = 0").select(doc, F.col("review").alias("_single"))
    rows = docs.join(merged, doc).join(single, doc).withColumn("response", F.when(F.col("chunks") > 1, F.col("response").cast(f"struct<{_fields()}>")).otherwise(F.col("_single").cast(f"struct<{_fields()}>")))
    done = post_process(rows.select(doc, "text", "language", "response", "context"), doc)
    note = X.chunk_note(tr, F.col("included_pages") < F.col("total_pages"), F.col("total_pages"), F.col("included_pages"), F.col("chunks"))
    out = done.join(rows.select(doc, "chunks", "language", "total_pages", "included_pages"), doc)
    return out.select(doc, F.col("review").withField("summary", F.when(F.col("chunks") > 1, F.concat(note, F.coalesce("review.summary", F.lit("")))).otherwise(F.col("review.summary"))).alias("review"))


def _fields() -> str:
    """REVIEW as the fields of a struct type."""
    import re

    return re.sub(r"(^|, )(\w+) ", r"\1\2:", REVIEW)


def review_documents(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """docs: doc, text (marked pages), summary, language. One row for each document: score, rationale, scrubbed summary, risks with verified pages, references. The rules alone, without a reviewer."""
    empty = F.from_json(F.lit("{}"), REVIEW).withField("summary", F.col("summary"))
    done = post_process(docs.withColumns({"response": empty, "context": F.array().cast(REFERENCES)}), doc)
    return done.select(doc, *(F.col(f"review.{c}").alias(c) for c in ("risk_score", "score_rationale", "summary", "risks")), F.transform("review.references", lambda x: x.source).alias("references"))
