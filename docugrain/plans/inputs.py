"""Inputs that both Spark and DuckDB derive from the tables by the same text, as the tables hold no statements.

Each is SQL over one table (or a subquery) with {div}, {grouped} and the like filled in for the dialect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.findings import STATEMENT_LINES
from ..sources.tables import table

SPARK = {"div": lambda a, b: f"({a} div {b})", "grouped": lambda x: f"format_number({x}, 0)", "day": lambda x: f"date_format({x}, 'yyyy-MM-dd')"}
DUCK = {"div": lambda a, b: f"({a} // {b})", "grouped": lambda x: f"format('{{:,}}', {x})", "day": lambda x: f"strftime({x}, '%Y-%m-%d')"}


def metrics(d: dict) -> list[str]:
    """Metric cards of orders: k, grp, label, value."""
    cents = "cast(floor(o_totalprice * 100 + 0.5) as bigint)"
    whole, part = d["div"](cents, 100), f"({cents} % 100)"
    tr = f"replace({d['grouped'](whole)}, ',', '.')"
    pad = f"lpad(cast({part} as varchar(2)), 2, '0')" if d is DUCK else f"lpad(cast({part} as string), 2, '0')"
    s = "varchar" if d is DUCK else "string"
    return [
        "o_orderkey as k", "o_custkey as grp",
        "case o_orderkey % 3 when 0 then 'Net Kâr' when 1 then 'FAVÖK Marjı' else concat('Dönem Karı ', o_orderstatus) end as label",
        f"""case o_orderkey % 6
        when 0 then concat({tr}, ',', {pad}, ' milyon TL')
        when 1 then concat('TL ', cast({whole} % 1000 as {s}), ',', cast({part} % 10 as {s}), ' trilyon')
        when 2 then concat('%', cast({whole} % 100 as {s}), ',', cast({part} % 10 as {s}))
        when 3 then concat('(', {tr}, ',', cast({part} % 10 as {s}), ') (', replace({d['grouped'](whole + ' + 7')}, ',', '.'), ',1) %11,8')
        when 4 then concat({d['grouped'](whole)}, '.', {pad}, ' million')
        else concat(cast({whole} % 100 as {s}), '.', {pad}, '% artış') end as value""",
        f"""case o_orderkey % 4 when 0 then concat({tr}, ',', {pad}) when 1 then concat({d['grouped'](whole)}, '.', {pad})
        when 2 then cast({whole} as {s}) else {tr} end as number""",
    ]


def findings(d: dict) -> list[str]:
    """Findings of events: severity by type, title by type and value."""
    s = "varchar" if d is DUCK else "string"
    return [
        "event_id", "user_id", f"{d['day']('ts')} as day",
        "case event_type when 'error' then 'CRITICAL' when 'purchase' then 'High' when 'signup' then 'MEDIUM' when 'click' then 'low' else 'NONE' end as severity",
        f"concat(' ', event_type, ' ', cast({d['div']('cast(floor(value) as bigint)', 10)} as {s}), ' ') as title",
    ]


# Statement texts: revenue of two years of each nation, as a line under two standards' headers.
def statements(d: dict) -> list[str]:
    """From (nation, year, tenths, before): language, text."""
    labels = [line[0] for line in STATEMENT_LINES]
    s = "varchar" if d is DUCK else "string"
    tr = lambda x: f"concat(replace({d['grouped'](d['div'](x, 10))}, ',', '.'), ',', cast({x} % 10 as {s}))"
    label = "case nation % 6 " + " ".join(f"when {k} then '{v}'" for k, v in enumerate(labels)) + " end"
    nl = "chr(10)"
    text = (f"concat('Giris {nl}', {nl}, 'TMS hukumlerine uygun tablo', {nl}, '  ', {label}, ' (', {tr('before')}, ') ', {tr('tenths')}, ' %', cast(nation + 20 as {s}), ',5', {nl}, "
            f"'UFRS esaslarina dayanan tablo', {nl}, '  ', {label}, ' ', {tr('before')}, ' ', {tr('(tenths + 7)')}, ' %74,7', {nl})")  # fmt: skip
    summary = f"concat(case when year % 3 = 0 then 'TMS secildi. ' when year % 3 = 1 then 'IFRS was chosen. ' else 'No standard. ' end, 'Tutar ', {tr('(tenths + 7)')}, ' oldu. Tutar ', {tr('tenths')}, ' milyon TL ve ', {tr('before')}, ' milyon TL artış gösterdi. Oran 74.7% idi!')"
    return ["nation", "year", "tenths", "before", "case when year % 2 = 0 then 'en' else 'tr' end as language", f"{text} as text", f"{summary} as summary"]


REVENUE = """select c_nationkey as nation, year, tenths, lag(tenths) over (partition by c_nationkey order by year) as before from (
select c_nationkey, cast(year(o_orderdate) as int) as year, cast(floor(sum(cast(floor(o_totalprice * 100 + 0.5) as bigint)) / 100000) as bigint) as tenths
from orders join customer on o_custkey = c_custkey group by 1, 2) t"""


def revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nation, year, tenths, before): sums by nation and year, and the year before. 150 rows whatever the size: the window sorts aggregates."""
    from pyspark.sql import Window

    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    cents = F.floor(F.col("o_totalprice") * 100 + 0.5).cast("bigint")
    sums = orders.join(customer, orders.o_custkey == customer.c_custkey).groupBy(F.col("c_nationkey").alias("nation"), F.year("o_orderdate").alias("year")).agg(F.floor(F.sum(cents) / 100000).cast("bigint").alias("tenths"))
    return sums.withColumn("before", F.lag("tenths").over(Window.partitionBy("nation").orderBy("year")))


def spark_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*metrics(SPARK))


def spark_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*findings(SPARK))


def spark_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revenue(spark, sf_dir).where("before is not null").selectExpr(*statements(SPARK))


DUCK_METRICS = f"(select {', '.join(metrics(DUCK))} from orders)"
DUCK_FINDINGS = f"(select {', '.join(findings(DUCK))} from events)"
DUCK_STATEMENTS = f"(select {', '.join(statements(DUCK))} from ({REVENUE}) r where before is not null)"
