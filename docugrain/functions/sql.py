"""Table functions for SQL: pages and chunks of marked texts, and the cap on a document's pages.

register(spark) makes them known to the session, so that SQL alone can use them:
``select d.id, p.page, p.body from docs d, lateral split_pages(d.text) p`` and ``select * from page_cap(table(select doc, page, text from pages), 3000000)``."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

MARKER = re.compile(r"\[REPORT PAGE (\d+)\]")


class SplitPages:
    """(page, body) of a marked text, in order of first mention; of a repeated number the last body holds. Null and unmarked texts give none."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        found, marks = {}, list(MARKER.finditer(text or ""))
        for k, m in enumerate(marks):
            end = marks[k + 1].start() if k + 1 < len(marks) else len(text)
            found[int(m[1])] = text[m.end() : end]
        yield from found.items()


class TextChunks:
    """(seq, chunk): a text up to the cap as it is; slices of it without two markers; else whole pages, as many as fit. A null text is one empty chunk."""

    def eval(self, text: str, cap: int) -> Iterator[tuple[int, str]]:
        yield from enumerate(self.chunks(text or "", cap))

    @staticmethod
    def chunks(text: str, cap: int) -> Iterator[str]:
        starts = [m.start() for m in MARKER.finditer(text)]
        if len(text) <= cap:
            yield text
        elif len(starts) < 2:
            yield from (text[k : k + cap] for k in range(0, len(text), cap))
        else:
            begin = 0
            for at, end in zip(starts, [*starts[1:], len(text)], strict=True):
                if end - begin > cap and at > begin:
                    yield text[begin:at]
                    begin = at
            yield text[begin:]


class PageCap:
    """The pages of a document before their running length, with markers, first passes the cap; the first one always. The table's columns are a document, a page and a text; Spark brings a document's rows together, in order of page."""

    def __init__(self) -> None:
        self.total, self.open = 0, True

    @staticmethod
    def analyze(pages: AnalyzeArgument, cap: AnalyzeArgument) -> AnalyzeResult:
        if not pages.isTable or len(pages.dataType.fields) != 3:
            raise ValueError("page_cap takes a table of three columns: document, page and text")
        doc, page, _ = pages.dataType.fields
        return AnalyzeResult(schema=pages.dataType, partitionBy=[PartitioningColumn(f"`{doc.name}`")], orderBy=[OrderingColumn(f"`{page.name}`")])

    def eval(self, row, cap: int):
        doc, page, text = row
        first = self.total == 0
        self.total += len(f"\n\n[REPORT PAGE {page}]\n{text or ''}")
        self.open = self.open and (first or self.total <= cap)
        if self.open:
            yield doc, page, text


def register(spark: SparkSession) -> None:
    pages = T.StructType([T.StructField("page", T.IntegerType()), T.StructField("body", T.StringType())])
    chunks = T.StructType([T.StructField("seq", T.IntegerType()), T.StructField("chunk", T.StringType())])
    spark.udtf.register("split_pages", F.udtf(SplitPages, returnType=pages, useArrow=True))
    spark.udtf.register("text_chunks", F.udtf(TextChunks, returnType=chunks, useArrow=True))
    spark.udtf.register("page_cap", F.udtf(PageCap, useArrow=True))
