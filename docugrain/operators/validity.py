"""Versions that hold for an interval of days: which hold on a day, and which overlap.

No range join: an interval is cut into dyadic ones (days 2^level * n to 2^level * (n + 1) - 1), at most two a level, and a day lies in one of
each level, so each day meets each interval that holds it once, by equality on key, level and n. Days that share a dyadic interval
of a hot key are dealt to as many salts as it takes to have at most some ``group`` of them together; its versions go to each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days that all intervals are cut to: 2^LEVELS from the first day asked for (179 years).
LEVELS = 16
GROUP = 100_000


def dyadic(first: Column, last: Column) -> Column:
    """The dyadic intervals (level, n) that make up days first to last, both from 0 to 2^LEVELS - 1; none if last is before first."""
    part = lambda level, n: F.array(F.struct(level.cast("int").alias("level"), n.cast("long").alias("n")))
    none = F.array().cast("array<struct<level:int,n:bigint>>")

    def step(s: Column, level: Column) -> Column:
        open_ = s.a <= s.b
        left, right = open_ & (s.a % 2 == 1), open_ & (s.b % 2 == 0)
        # The last interval of all may be both ends.
        both = left & right & (s.a == s.b)
        out = F.concat(s.out, F.when(left, part(level, s.a)).otherwise(none), F.when(right & ~both, part(level, s.b)).otherwise(none))
        a, b = F.when(left, s.a + 1).otherwise(s.a), F.when(right, s.b - 1).otherwise(s.b)
        # Once empty it stays so: halves of an empty range could be a range again.
        more = a <= b
        return F.struct(F.when(more, F.floor(a / 2)).otherwise(1).cast("long").alias("a"), F.when(more, F.floor(b / 2)).otherwise(0).cast("long").alias("b"), out.alias("out"))

    start = F.struct(first.cast("long").alias("a"), last.cast("long").alias("b"), none.alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), start, step)["out"]


def holding(asked: DataFrame, versions: DataFrame, key: str, day: str, since: str, until: str, carry: list[str], group: int = GROUP) -> DataFrame:
    """asked with since, until and the carried columns of each version of its key that holds on its day (bounds belong to it, null ones are open). Rows without key or day, and days without a version, give none."""
    span = asked.agg(F.min(day).alias("lo"), F.max(day).alias("hi")).first()
    rows = asked.where(F.col(key).isNotNull() & F.col(day).isNotNull())
    base = F.unix_date(F.lit(span.lo).cast("date"))
    at = lambda c: F.unix_date(F.col(c).cast("date")) - base
    top = F.lit(2**LEVELS - 1)
    if span.lo is not None and (span.hi - span.lo).days >= 2**LEVELS:
        raise ValueError(f"days asked for lie more than {2**LEVELS} apart")
    own = versions.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_v_{c}") for c in dict.fromkeys([since, until, *carry])), F.greatest(F.coalesce(at(since), F.lit(0)), F.lit(0)).alias("_a"), F.least(F.coalesce(at(until), top), top).alias("_b"))
    parts = own.select("*", F.explode(dyadic(F.col("_a"), F.col("_b"))).alias("d")).select("_key", F.col("d.level").alias("_level"), F.col("d.n").alias("_n"), *(c for c in own.columns if c.startswith("_v_")))
    days = rows.withColumns({"_key": F.col(key), "_at": at(day)})
    levels = F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright(F.col("_at").cast("long"), k).alias("n")) for k in range(LEVELS + 1)))
    spread = days.withColumn("d", F.explode(levels)).withColumns({"_level": F.col("d.level"), "_n": F.col("d.n")}).drop("d")
    # Only intervals that some version has; and how many salts the days in each take.
    cells = spread.groupBy("_key", "_level", "_n").agg(F.ceil(F.count(F.lit(1)) / group).cast("int").alias("_salts"))
    wanted = parts.select("_key", "_level", "_n").distinct().join(cells, ["_key", "_level", "_n"])
    left = spread.join(wanted, ["_key", "_level", "_n"]).withColumn("_salt", F.pmod(F.xxhash64(*asked.columns), F.col("_salts")).cast("int"))
    right = parts.join(wanted, ["_key", "_level", "_n"]).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    both = left.join(right.drop("_salts"), ["_key", "_level", "_n", "_salt"])
    return both.select(*asked.columns, *(F.col(f"_v_{c}").alias(c) for c in dict.fromkeys([since, until, *carry])))


def _nodes(first: Column, last: Column) -> Column:
    """The dyadic intervals that make up days first to last, by number (2^(LEVELS - level) + n), with nulls between."""
    out = []
    for level in range(LEVELS + 1):
        a, b, root = F.shiftright(first + (2**level - 1), level), F.shiftright(last + 1, level) - 1, 2 ** (LEVELS - level)
        out += [F.when((a <= b) & (a % 2 == 1), a + root), F.when((a <= b) & (b % 2 == 0), b + root)]
    return F.array(*out)


def tallies(days: DataFrame, versions: DataFrame, key: str, day: str, since: str, until: str, id_: str) -> DataFrame:
    """key, day, n, first and last: for each key and day asked for how many versions of the key hold on it, and the least and greatest id of them. No row for days on which none holds.

    Versions are counted by dyadic interval before days meet them, and each day of a key is looked up once, so work and
    shuffled rows grow with versions and days, not with the pairs of them."""
    asked = days.where(F.col(key).isNotNull() & F.col(day).isNotNull()).select(F.col(key).alias("_key"), F.col(day).cast("date").alias("_day")).distinct()
    span = days.agg(*(f(F.unix_date(F.col(day).cast("date"))) for f in (F.min, F.max))).first()
    lo, most = (0, 0) if span[0] is None else (span[0], span[1] - span[0])
    if most >= 2**LEVELS:
        raise ValueError(f"days asked for lie more than {2**LEVELS} apart")
    top = F.lit(most)
    at = lambda c: F.unix_date(F.col(c).cast("date")) - lo
    own = versions.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(id_).alias("_id"), F.greatest(F.coalesce(at(since), F.lit(0)), F.lit(0)).alias("_a"), F.least(F.coalesce(at(until), top), top).alias("_b"))
    parts = own.where("_a <= _b").select("_key", "_id", F.explode(_nodes(F.col("_a"), F.col("_b"))).alias("_node")).where("_node is not null")
    cells = parts.groupBy("_key", "_node").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("first"), F.max("_id").alias("last"))
    leaf = at("_day") + 2**LEVELS
    looked = asked.select("_key", "_day", F.explode(F.array(*(F.shiftright(leaf, k) for k in range(LEVELS + 1)))).alias("_node"))
    met = looked.join(cells, ["_key", "_node"]).groupBy("_key", "_day").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    return met.select(F.col("_key").alias(key), F.col("_day").alias(day), "n", "first", "last")


def conflicts(versions: DataFrame, key: str, id_: str, since: str, until: str) -> DataFrame:
    """key, id, n and first: versions that begin while another one of their key holds, with how many do and the least id of them. Of two that begin on one day the one of greater id is the later; null begins are before all. Ids are unique within a key.

    Those that began on earlier days are tallied by day; those of the same day are counted by rank."""
    early = F.lit("0001-01-01").cast("date")
    own = versions.where(F.col(key).isNotNull()).select(F.col(key).alias(key), F.col(id_).alias("_id"), F.col(since).cast("date").alias("_since"), F.col(until).cast("date").alias("_until"))
    least = F.date_from_unix_date(F.lit(own.agg(F.min(F.unix_date("_since"))).first()[0]).cast("int"))
    # A version without a begin holds from the first day of all.
    own = own.where(F.coalesce("_since", least).isNotNull() & (F.col("_until").isNull() | (F.col("_until") >= F.coalesce("_since", least)))).withColumn("_from", F.coalesce("_since", early))
    before = tallies(own.where(F.col("_since") > early), own.withColumn("_next", F.date_add("_from", 1)), key, "_since", "_next", "_until", "_id").select(F.col(key).alias("_key"), F.col("_since").alias("_day"), F.col("n").alias("_n"), F.col("first").alias("_first"))
    w = Window.partitionBy(key, "_from").orderBy("_id")
    ranked = own.withColumns({"_rank": F.rank().over(w), "_least": F.min("_id").over(w)})
    met = ranked.join(before, (F.col(key) == F.col("_key")) & (F.col("_since") == F.col("_day")), "left")
    n, same = F.coalesce("_n", F.lit(0)) + F.col("_rank") - 1, F.when(F.col("_rank") > 1, F.col("_least"))
    return met.select(key, F.col("_id").alias(id_), n.alias("n"), F.least("_first", same).alias("first")).where("n > 0").groupBy(key, id_).agg(F.sum("n").alias("n"), F.min("first").alias("first"))
