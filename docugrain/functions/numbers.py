"""Numbers in statement texts, as Column expressions (no Python workers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number patterns of the financial texts.
METRIC_NUMBER = r"\d{1,3}(?:\.\d{3})+(?:,\d+)?|\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+[.,]\d+|\d+"
MONEY_TOKEN = r"\d{1,3}(?:\.\d{3})+(?:,\d+)?|\d+,\d+"
PERCENT = r"%\s?\d{1,3}(?:[.,]\d+)?|\d{1,3}(?:[.,]\d+)?\s?%"
MULTIPLIER = r"(?i)\b(bin|milyon|milyar|trilyon|thousand|million|billion|trillion)\b"
# What the multiplier words stand for.
MULTIPLIERS = {"bin": 1e3, "thousand": 1e3, "milyon": 1e6, "million": 1e6, "milyar": 1e9, "billion": 1e9, "trilyon": 1e12, "trillion": 1e12}


def tr_number(text: Column) -> Column:
    """Dots group, a comma is the decimal mark, parentheses are dropped without negating; null if it is no number."""
    return F.replace(F.translate(text, "().", ""), F.lit(","), F.lit(".")).try_cast("double")


def amount(text: Column) -> Column:
    """The right-most of comma and dot is the decimal mark, all others group."""
    head, tail = (F.regexp_extract(text, r"^(.*)[.,]([^.,]*)$", k) for k in (1, 2))
    return F.when(text.rlike("[.,]"), F.concat(F.translate(head, ".,", ""), F.lit("."), tail).try_cast("double")).otherwise(text.try_cast("double"))


def flexible_number(text: Column) -> Column:
    """Groups of three after dots (or commas) group; any other comma is a decimal mark; -1 if it is no number."""
    s = F.btrim(text)
    plain = (F.when(s.rlike(r"^\d{1,3}(\.\d{3})+(,\d+)?$"), F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
             .when(s.rlike(r"^\d{1,3}(,\d{3})+(\.\d+)?$"), F.replace(s, F.lit(","), F.lit(""))).otherwise(F.replace(s, F.lit(","), F.lit("."))))
    return F.coalesce(plain.try_cast("double"), F.lit(-1.0))


def tenth(x: Column) -> Column:
    """Half up to one decimal, as a count of tenths."""
    return F.floor(x * 10 + 0.5).cast("bigint")


def canonical_number(text: Column) -> Column:
    """'41' for whole numbers, else one decimal, rounded half up ('74.96' is '75.0')."""
    d = F.replace(text, F.lit(","), F.lit(".")).try_cast("double")
    t = tenth(d)
    return F.when(F.abs(d - F.rint(d)) < 1e-9, F.rint(d).cast("bigint").cast("string")).otherwise(F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string")))


def canonical_percents(text: Column) -> Column:
    """The percentages of a text, whatever their format, as distinct canonical numbers in order."""
    found = F.regexp_extract_all(text, F.lit(PERCENT), F.lit(0))
    return F.array_distinct(F.transform(found, lambda p: canonical_number(F.regexp_replace(p, r"[%\s]", ""))))


def money_tokens(text: Column) -> Column:
    """Distinct amounts without dots, of four digits at least."""
    found = F.transform(F.regexp_extract_all(text, F.lit(MONEY_TOKEN), F.lit(0)), lambda t: F.replace(t, F.lit("."), F.lit("")))
    return F.array_distinct(F.filter(found, lambda t: F.length(F.replace(t, F.lit(","), F.lit(""))) >= 4))


def magnitude(text: Column) -> Column:
    """The first number times the first multiplier word after it; -1 without a number. Percentages don't count."""
    rest = F.regexp_replace(text, PERCENT, " ")
    number = F.regexp_extract(rest, f"({METRIC_NUMBER})", 1)
    after = F.substring(rest, F.instr(rest, number) + F.length(number), F.length(rest))
    word = F.lower(F.regexp_extract(after, MULTIPLIER, 1))
    factor = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in MULTIPLIERS.items() for x in kv)), word), F.lit(1.0))
    d = flexible_number(number)
    return F.when(text.isNull() | (number == "") | (d < 0), -1.0).otherwise(d * factor)


def precision_digits(text: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(F.regexp_extract(text, f"({METRIC_NUMBER})", 1), r"\D", "")), F.lit(0))


def _grouped(whole: Column, en: Column) -> Column:
    text = F.format_number(whole, 0)
    return F.when(en, text).otherwise(F.replace(text, F.lit(","), F.lit(".")))


def formatted(x: Column, en: Column) -> Column:
    """One decimal of the absolute value, half up, with groups: 26,211.3 in English, 26.211,3 in Turkish."""
    a = F.abs(x)
    whole = F.floor(a).cast("bigint")
    t = F.floor((a - whole) * 10 + 0.5).cast("bigint")
    return F.concat(_grouped(whole + F.floor(t / 10).cast("bigint"), en), F.when(en, ".").otherwise(","), (t % 10).cast("string"))


def formatted_percent(x: Column, en: Column) -> Column:
    t = tenth(x)
    whole, part = F.floor(t / 10).cast("string"), (t % 10).cast("string")
    return F.when(en, F.concat(whole, F.lit("."), part, F.lit("%"))).otherwise(F.concat(F.lit("%"), whole, F.lit(","), part))


def clean_metric(text: Column) -> Column:
    """A series of bracketed amounts becomes its last one, with the last percentage if there is any."""
    v = F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    amounts = F.regexp_extract_all(v, F.lit(r"\(([\d.,]+)\)"), F.lit(1))
    percents = F.regexp_extract_all(v, F.lit(r"%\s?[\d.,]+"), F.lit(0))
    tail = F.when(F.size(percents) > 0, F.concat(F.lit(" ("), F.element_at(percents, -1), F.lit(")"))).otherwise("")
    return F.when(F.size(amounts) >= 2, F.concat(F.element_at(amounts, -1), tail)).otherwise(text)
