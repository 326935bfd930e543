"""Texts, labels and lexicons, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stems that tell a direction, standards' names, headers of the standards' tables, citations and markers.
INCREASE = r"(?iu)artı[şs]|artmı[şs]|increase|increased|rose|\bup\b|higher|y[üu]ksel"
DECREASE = r"(?iu)azal|d[üu][şs]|decreas|declin|fell|lower|geriled"
SCALED = r"(?i)(\d[\d.,]*)\s*(?:milyon|million|milyar|billion|bin|TL|₺)"
STANDARD_TMS = r"(?iu)\bTMS\b|T[üu]rkiye Muhasebe|Turkish Accounting"
STANDARD_IFRS = r"(?iu)\b(UFRS|IFRS)\b|Uluslararas[ıi] Finansal|International Financial"
HEADER_TMS = r"(?i)(TMS)[^\n]{0,80}(uygun|hazirlan|dayan)"
HEADER_IFRS = r"(?i)(UFRS|IFRS)[^\n]{0,80}(uygun|hazirlan|dayan)"
MARKER = r"\[REPORT PAGE (\d+)\]"
MARKER_IN_TEXT = r"(?i)\s*\[REPORT PAGE \d+\]\s*"
CITATION = r"(?i)\((?:Rapor\s+)?(?:Sayfa|Report\s+Page|Page)\s+[0-9,\s-]+\)"
# Document types with an instruction of their own; any other is financial.
DOCUMENT_TYPES = ["rental", "subscription", "insurance", "vehicle", "employment", "general"]
# Ranks of severities.
SEVERITIES = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}
TERM_SPLIT = r"[^a-z0-9çğıöşü]+"


def lower_tr(text: Column) -> Column:
    """Lower case by Turkish rules: dotted and dotless i keep apart."""
    return F.lower(F.translate(F.coalesce(text, F.lit("")), "İI", "iı"))


def nfkc(name: str = "nfkc"):
    """The one string function without a built-in form, as an Arrow-batched function."""

    @F.pandas_udf("string")
    def normalise(column):
        return column.str.normalize("NFKC")

    return normalise


def terms(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, TERM_SPLIT), lambda t: F.length(t) > 2))


def contains_keyword(text: Column, words: Column, keyword: Column) -> Column:
    return F.when(F.instr(keyword, " ") > 0, F.contains(text, keyword)).otherwise(F.array_contains(words, keyword))


def canon_label(label: Column) -> Column:
    folded = F.translate(lower_tr(label), "ıçğöşüâîû", "icgosuaiu")
    return F.btrim(F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9 ]", " "), r" {2,}", " "))


def shares_token(a: Column, b: Column) -> Column:
    """A token of three characters or more is in both canonical labels."""
    own = lambda c: F.filter(F.split(c, " "), lambda t: F.length(t) >= 3)
    return F.arrays_overlap(own(a), own(b))


def strip_markers(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(text, MARKER_IN_TEXT, " "), r"\s{2,}", " "))


def rewrite_citation(text: Column, pages: Column, turkish: Column) -> Column:
    """Markers go; citations become the verified pages, which are added if none is there."""
    own = F.concat(F.when(turkish, "(Sayfa ").otherwise("(Page "), F.array_join(pages.cast("array<string>"), ", "), F.lit(")"))
    out = F.regexp_replace(strip_markers(text), F.lit(CITATION), own)
    return F.when(F.contains(out, own), out).otherwise(F.concat(F.rtrim(out), F.lit(" "), own))


def severity_rank(severity: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in SEVERITIES.items() for x in kv))
    return F.coalesce(F.try_element_at(known, F.upper(F.coalesce(severity, F.lit("")))), F.lit(0))


def finding_key(title: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(title, F.lit("")), r"^[\x00-\x20]+|[\x00-\x20]+$", ""))


def contradicts_direction(title: Column, evidence: Column) -> Column:
    """The text claims an increase, and no decrease, but the second scaled amount is below the first."""
    from .numbers import amount

    text = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(evidence, F.lit("")))
    found = F.filter(F.transform(F.regexp_extract_all(F.coalesce(evidence, F.lit("")), F.lit(SCALED), F.lit(1)), amount), lambda v: v.isNotNull())
    return text.rlike(INCREASE) & ~text.rlike(DECREASE) & F.coalesce(F.get(found, F.lit(1)) < F.get(found, F.lit(0)), F.lit(False))


def document_type(name: Column) -> Column:
    n = F.lower(F.btrim(name))
    return F.when(n.isin(*DOCUMENT_TYPES), n).otherwise("financial")


def chunk_note(turkish: Column, truncated: Column, total: Column, included: Column, chunks: Column) -> Column:
    t, i, c = (x.cast("string") for x in (total, included, chunks))
    part = F.when(turkish, F.concat(F.lit("Not: "), t, F.lit(" sayfalık belgenin ilk "), i, F.lit(" sayfası "), c, F.lit(" bölüme ayrılarak incelenmiştir; kalan sayfalar bu incelemeye dâhil değildir. "))).otherwise(
        F.concat(F.lit("Note: The first "), i, F.lit(" of "), t, F.lit(" pages were reviewed across "), c, F.lit(" sections; the remaining pages are not included. ")))
    full = F.when(turkish, F.concat(F.lit("Not: "), t, F.lit(" sayfalık belge "), c, F.lit(" bölüme ayrılarak bütünüyle incelenmiştir. "))).otherwise(
        F.concat(F.lit("Note: This "), t, F.lit("-page document was reviewed in full across "), c, F.lit(" sections. ")))
    return F.when(truncated, part).otherwise(full)


def rationale(high: Column, mid: Column, turkish: Column) -> Column:
    h, m = high.cast("string"), mid.cast("string")
    return F.when(turkish, F.concat(F.lit("Belge genelinde "), h, F.lit(" yüksek ve "), m, F.lit(" orta önem düzeyinde dikkat noktası tespit edilmiştir."))).otherwise(
        F.concat(h, F.lit(" high and "), m, F.lit(" medium severity attention points were identified across the document.")))
