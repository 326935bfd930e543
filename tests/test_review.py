"""Document-review operators: the golden values, and each query against its SQL on the smallest tables."""

import hashlib
import hmac
import base64

import duckdb
import pytest
from pyspark.sql import functions as F

from docugrain.functions import numbers as N
from docugrain.functions import text as X
from docugrain.operators import findings, pages, requests
from docugrain.plans import catalog

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(spark, column, **columns):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in columns.items())).select(column.alias("v")).first().v


@pytest.mark.parametrize(("given", "want"), [("19.917,1", 19917.1), ("26.211", 26.211), ("1300", 1300.0), ("12.", 12.0), ("x", None)])
def test_amount(spark, given, want):
    assert value(spark, N.amount(F.col("x")), x=given) == want


@pytest.mark.parametrize(("given", "want"), [("3.523", 3523.0), ("3,5", 3.5), ("3,523.4", 3523.4), ("a", -1.0)])
def test_flexible_number(spark, given, want):
    assert value(spark, N.flexible_number(F.col("x")), x=given) == want


def test_percents_and_magnitudes(spark):
    assert value(spark, N.canonical_percents(F.col("x")), x="%74,7 74.7% %41,0 41% %74,96") == ["74.7", "41", "75.0"]
    assert [value(spark, N.magnitude(F.col("x")), x=x) for x in ("3.523 milyar TL", "TL 3,5 trilyon", "%41")] == [3.523e12, 3.5e12, -1.0]
    assert value(spark, N.clean_metric(F.col("x")), x="(2.609,7) (2.917,3) %11,8") == "2.917,3 (%11,8)"


@pytest.mark.parametrize(("counts", "want"), [((0, 0, 0, 0), 100), ((0, 0, 0, 1), 97), ((0, 0, 0, 7), 80), ((0, 0, 1, 0), 79), ((0, 0, 6, 0), 55), ((0, 1, 0, 0), 54), ((0, 3, 0, 0), 30), ((1, 0, 0, 0), 29), ((3, 0, 0, 0), 0)])
def test_scores(spark, counts, want):
    assert value(spark, findings.calibrated(*map(F.lit, counts))) == want


def test_statement_findings(spark):
    rows = spark.createDataFrame([(1, "tr", "Finansman giderleri (1.000,0) (1.250,5)"), (2, "tr", "Dönem Karı 1.000,0 800,0"), (3, "tr", "Dönem Karı 1.000,0 800,1"), (4, None, None)], "id int, language string, text string")
    got = {r.id: (r.title, r.severity) for r in findings.statement_findings(rows, "id").collect()}
    assert got == {1: ("Finansman giderleri %25,1 oranında arttı", "MEDIUM"), 2: ("Dönem kârı %20,0 oranında düştü", "MEDIUM")}


def test_grounding(spark):
    e = spark.createDataFrame([(1, 1, "44,8"), (2, 1, "10,5 20,5")], "doc int, item int, evidence string")
    p = spark.createDataFrame([(1, 1, "44,8 x"), (1, 2, "144,8 44,85"), (2, 5, "10,5 20,5"), (2, 2, "10,5 20,5")], "doc int, page int, body string")
    assert {r.doc: r.pages for r in pages.ground(e, p, "doc", "item").collect()} == {1: [1], 2: [2]}


def test_chunks_and_direction(spark):
    assert value(spark, pages.greedy_chunks(F.array(*(F.lit(n).cast("bigint") for n in (50, 60, 30, 80))), 110)) == [0, 0, 1, 1]
    assert value(spark, X.contradicts_direction(F.lit("artış"), F.lit("19.917,1 milyon TL sonra 15.114,0 milyon TL")))


def test_scrub_keeps_the_text_if_all_would_go(spark):
    lock = F.array(F.lit("11678,7")), F.array(F.lit("74.7"))
    assert value(spark, pages.scrub(F.col("x"), *lock), x="Oran %74,7. Tutar 11.678,7!") == "Oran %74,7. Tutar 11.678,7!"
    assert value(spark, pages.scrub(F.col("x"), *lock), x="Oran 74.7%. Kalan iyi.") == "Kalan iyi."


def test_uploads(spark):
    for name, content, want in (("a.txt", "hello", "NOT_PDF_NAME"), ("a.pdf", "hello", "NOT_PDF_CONTENT"), ("A.PDF", "%PDF-1", None), ("a.pdf", "", "EMPTY")):
        assert value(spark, requests.upload_error(F.lit(name), F.lit(content), F.lit(len(content)))) == want


def test_tokens_equal_the_standard_library(spark):
    for r in catalog.token_roundtrip(spark, SMALL).limit(20).collect():
        payload, mac = r.token.split(".")
        text = base64.urlsafe_b64decode(payload + "==")
        want = base64.urlsafe_b64encode(hmac.new(b"a shared secret of the test", text, hashlib.sha256).digest()).rstrip(b"=").decode()
        assert mac == want and r.verified == r.device and text.decode().startswith(r.device)


def test_a_constant_key_is_worked_out_once(spark):
    """The key's 128 digits were mapped for each row anew."""
    rows = spark.range(3).select(requests.hmac_sha256(F.lit("key"), F.col("id").cast("string")).alias("mac"), requests.hmac_sha256(F.concat(F.lit("k"), F.col("id").cast("string")), F.lit("x")).alias("by"))
    plan = rows.select("mac")._jdf.queryExecution().optimizedPlan().toString()
    assert "translate" not in plan and "transform" not in plan
    for k, r in enumerate(rows.collect()):
        assert r.mac == hmac.new(b"key", str(k).encode(), hashlib.sha256).hexdigest() and r.by == hmac.new(f"k{k}".encode(), b"x", hashlib.sha256).hexdigest()


def test_dedupe_metrics_equals_a_plain_loop(spark):
    cards = catalog._cards(spark, SMALL).orderBy("grp", "k").collect()
    groups = {}
    for r in cards:
        groups.setdefault(r.grp, []).append(r.m)

    def same(a, b):
        if a.label and a.label == b.label:
            return True
        if a.percents and set(a.percents) == set(b.percents) and {t for t in a.label.split() if len(t) > 2} & {t for t in b.label.split() if len(t) > 2}:
            return True
        return min(a.magnitude, b.magnitude) >= 100000 and abs(a.magnitude - b.magnitude) / max(a.magnitude, b.magnitude) <= 0.02

    want = {}
    for g, ms in groups.items():
        kept = []
        for m in ms[:6]:
            at = next((i for i, k in enumerate(kept) if same(k, m)), None)
            if at is None:
                kept.append(m)
            elif m.digits > kept[at].digits:
                kept[at] = m
        want[g] = "|".join(m.value for m in kept)
    assert {r.grp: r.kept for r in catalog.dedupe_metrics(spark, SMALL).collect()} == want


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SMALL).toPandas(), duck.execute(catalog.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda d: sorted(repr([None if x is None or x != x else round(float(x), 6) if isinstance(x, float) else str(x) for x in r]) for r in d[columns].itertuples(index=False))
    assert rows(got) == rows(want)


def test_no_cartesian_product_but_with_single_rows(spark):
    for name in catalog.QUERIES:
        if name.startswith("stream"):
            continue
        plan = catalog.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
