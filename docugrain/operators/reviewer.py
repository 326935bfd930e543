"""The reviewer seam: something that turns a chunk of text into a review, in Arrow batches, with retries.

The default works offline and gives an empty review, so that the deterministic rules decide. A service is called only by
a client that the caller passes; it must be picklable and raise Temporary for what may pass (429, 5xx, input and output)."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.tables import REVIEW, written
from .pages import PROMPT_CAP


SEPARATOR = "\n---\n"
#: What is asked of a reviewer that merges summaries.
MERGE = {
    "tr": "Bir belgenin bölümlerine ait özetler aşağıdadır. Hepsinden tek bir yönetici özeti yaz; özetten başka bir şey yazma.",
    "en": "These are summaries of a document's sections. Write a single executive summary of all of them, and nothing but the summary.",
}


#: What a reviewer is asked to look for, by type of document; all but financial reports share the first sentence.
COMMON = "Report only what the text says; give no advice on law, and name a risk with the words that carry it. "
TASKS = {
    "financial": "Look at results against the year before, debt and interest, cash flow, currency exposure, going concern, provisions and what the auditor remarks.",
    "rental": COMMON + "Look at rent and how it rises, the deposit and its return, how long it runs and renews, notice and eviction, penalties, upkeep and further charges.",
    "subscription": COMMON + "Look at the whole cost and when it falls due, the minimum term, automatic renewal, fees for leaving early, price changes and how to cancel.",
    "insurance": COMMON + "Look at what is covered and up to what sum, exclusions, the excess, waiting times, premiums, cancellation and the deadlines for claims.",
    "vehicle": COMMON + "Look at price and payment, delivery, condition and warranty, damage and mileage as declared, disclaimers and the transfer of ownership.",
    "employment": COMMON + "Look at pay and benefits, probation, hours and overtime, competition and secrecy clauses, penalties, notice, inventions and changes by one side.",
    "general": COMMON + "Look at what each side owes, payments and penalties, deadlines, renewal, how to end it and who bears which liability.",
}


class Temporary(Exception):
    """A failure that a later attempt may not have."""


def offline(prompt: str) -> str:
    return json.dumps({"risk_score": 100, "summary": "", "risks": [], "recommendations": [], "key_metrics": [], "advisor_questions": [], "references": []})


def with_retries(call: Callable[[str], str], attempts: int = 3, first_wait: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """Up to so many attempts; waits double. Other failures, and the last one, go on to the caller."""

    def run(prompt: str) -> str:
        for k in range(attempts):
            try:
                return call(prompt)
            except Temporary:
                if k == attempts - 1:
                    raise
                sleep(first_wait * 2**k)
        raise AssertionError("no attempt")

    return run


def prompts(chunks: DataFrame, *keys: str, text: str = "text", kind: str = "document_type", language: str = "language", context: str | None = None) -> DataFrame:
    """One prompt for each chunk: its type, what to look for in it and its language, the provisions that may matter, if there are any, then the first characters of its text up to the cap."""
    tasks = F.create_map(*(F.lit(x) for k in TASKS.items() for x in k))
    type_ = X.document_type(F.col(kind))
    head = F.concat(F.lit("Review this document. Type: "), type_, F.lit(". "), F.coalesce(F.try_element_at(tasks, type_), F.lit(TASKS["general"])), F.when(F.lower(F.col(language)) == "tr", " Yanıt dili: Türkçe.\n\n").otherwise("\n\n"))
    body = F.substring(text, 1, PROMPT_CAP)
    if context:
        lines = F.array_join(F.transform(context, lambda c: F.concat_ws(" - ", c.source, c.article, c.title)), "\n")
        head = F.concat(head, F.when(F.size(context) > 0, F.concat(F.lit("Provisions that may matter:\n"), lines, F.lit("\n\n"))).otherwise(""))
    return chunks.select(*keys, F.concat(head, body).alias("prompt"))


def replies(asked: DataFrame, *keys: str, call: Callable[[str], str], lenient: bool = False) -> DataFrame:
    """keys and the reply to each prompt, as a written table: a service is asked once for each prompt, whatever reads its reply. If lenient, a failure is a null reply."""
    ask = with_retries(call)

    def attempt(prompt: str) -> str | None:
        try:
            return ask(prompt)
        except Exception:
            if not lenient:
                raise
            return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(reply=[attempt(p) for p in frame["prompt"]])[[*keys, "reply"]]

    types = dict(asked.dtypes)
    return written(asked.mapInPandas(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", reply string"), "replies")


def review(asked: DataFrame, *keys: str, call: Callable[[str], str] = offline) -> DataFrame:
    """keys and the review of each prompt, each asked for once; a reply that isn't of the schema fails the query."""
    return replies(asked, *keys, call=call).select(*keys, F.from_json("reply", REVIEW, {"mode": "FAILFAST"}).alias("review"))


def no_synthesis(prompt: str) -> str:
    """A blank reply, upon which the first summary stands for all."""
    return ""


def _packs(texts: Column, cap: int) -> Column:
    """Texts in order, in groups whose joined text stays within the cap, of two at least."""
    start = F.struct(F.array().cast("array<int>").alias("of"), F.lit(0).alias("held"), F.lit(0).alias("n"), F.lit(0).alias("pack"))

    def add(s: Column, t: Column) -> Column:
        size = F.length(t) + len(SEPARATOR)
        opens = (s.n >= 2) & (s.held + size > cap)
        pack = F.when(opens, s.pack + 1).otherwise(s.pack)
        return F.struct(F.array_append(s.of, pack).alias("of"), F.when(opens, size).otherwise(s.held + size).alias("held"), F.when(opens, F.lit(1)).otherwise(s.n + 1).alias("n"), pack.alias("pack"))

    of = F.aggregate(texts, start, add)["of"]
    return F.transform(F.sequence(F.lit(0), F.array_max(of)), lambda k: F.filter(texts, lambda t, i: F.get(of, i) == k))


def synthesize(parts: DataFrame, doc: str, order: str, summary: str, turkish: str, call: Callable[[str], str] = no_synthesis, cap: int = PROMPT_CAP) -> DataFrame:
    """(doc, summary): one summary from those of a document's parts, blank ones aside; none without any.

    One of a document stands as it is. Several are merged by the reviewer, in one call as long as they fit in a prompt, else in
    a tree: those that fit together are merged, then what comes of them. Where a call fails or replies nothing, the first of
    its summaries stands. A document's summaries are few, as its chunks are."""
    said = parts.where(F.col(summary).rlike(r"\S"))
    level = written(said.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(summary).alias("s")))).alias("x"), F.first(turkish).alias("tr")).select(doc, F.transform("x", lambda x: x.s).alias("texts"), "tr"), "summaries")
    while level.where(F.size("texts") > 1).limit(1).count():
        packs = level.select(doc, "tr", F.posexplode(_packs(F.col("texts"), cap)).alias("pack", "of"))
        task = F.when(F.col("tr"), MERGE["tr"]).otherwise(MERGE["en"])
        asked = packs.where(F.size("of") > 1).select(doc, "pack", F.concat(task, F.lit("\n\n"), F.substring(F.array_join("of", SEPARATOR), 1, cap)).alias("prompt"))
        told = replies(asked, doc, "pack", call=call, lenient=True)
        one = F.when(F.col("reply").rlike(r"\S"), F.regexp_replace("reply", r"^[\x00-\x20]+|[\x00-\x20]+$", "")).otherwise(F.get("of", F.lit(0)))
        after = packs.join(told, [doc, "pack"], "left").select(doc, "tr", "pack", one.alias("s"))
        level = written(after.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("pack", "s"))).alias("x"), F.first("tr").alias("tr")).select(doc, F.transform("x", lambda x: x.s).alias("texts"), "tr"), "summaries")
    return level.select(doc, F.get("texts", F.lit(0)).alias("summary"))
