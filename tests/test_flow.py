"""Sources, sinks, reviewer and the review from end to end."""

import json

import pytest
from pyspark.sql import functions as F

from docugrain.operators import corpus, findings, pages, reviewer, state
from docugrain.plans import review
from docugrain.sources import tables


def test_review_of_a_document(spark):
    text = ("[REPORT PAGE 1]\nTMS hukumlerine uygun\nFinansman giderleri 1.000,0 1.250,5\nDönem Karı 900,0 500,0\n[REPORT PAGE 2]\nUFRS esaslarina dayanan\nFinansman giderleri 1.000,0 1.900,5 oran %90,1\n")
    docs = spark.createDataFrame([(1, text, "TMS. Oran %90,1. Kalan iyi.", "tr"), (2, "plain", None, "en")], "doc int, text string, summary string, language string")
    a, b = review.review_documents(docs).orderBy("doc").collect()
    assert a.risk_score == 79  # two of medium severity: 84, within the band 55 to 79
    assert [r.title for r in a.risks] == ["Dönem kârı %44,4 oranında düştü", "Finansman giderleri %25,1 oranında arttı"]
    assert all(r.evidence.endswith("(Sayfa 1)") for r in a.risks) and a.references == ["Rapor Sayfa 1"] and a.summary == "TMS. Kalan iyi."
    assert (b.risk_score, b.risks, b.references, b.summary) == (100, [], [], None)


def test_reviewer_retries(spark):
    waits, calls = [], []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise reviewer.Temporary
        return "{}"

    assert reviewer.with_retries(flaky, sleep=waits.append)("p") == "{}" and waits == [2.0, 4.0]
    calls.clear()
    with pytest.raises(reviewer.Temporary):
        reviewer.with_retries(flaky, attempts=2, sleep=waits.append)("p")
    rows = spark.createDataFrame([(1, "x" * 200_000, "Rental ", "tr")], "doc int, text string, document_type string, language string")
    asked = reviewer.prompts(rows, "doc")
    assert 120_000 < len(asked.first().prompt) < 120_600
    assert reviewer.review(asked, "doc").first().review.risks == []


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(b"%PDF-1")
    (tmp_path / "in/b.txt").write_bytes(b"x")
    assert [r.length for r in tables.uploads(spark, f"{tmp_path}/in").collect()] == [6]
    (tmp_path / "c.json").write_text(json.dumps([{"id": "1", "source": "s", "article": "a", "title": "t", "text": "x", "keywords": ["k"]}]))
    row = tables.provisions(spark, f"{tmp_path}/c.json").first()
    assert row.keywords == ["k"] and row.status is None
    usage = lambda *rows: tables.upsert_usage(spark.createDataFrame(list(rows), "device string, month string"), f"{tmp_path}/u", "device")
    assert [(r.device, r.used_count) for r in usage(("d", "2024-01"), ("d", "2024-01")).collect()] == [("d", 2)]
    assert {(r.device, r.used_count) for r in usage(("d", "2024-01"), ("e", "2024-01")).collect()} == {("d", 3), ("e", 1)}
    assert spark.read.parquet(f"{tmp_path}/u/month=2024-01/v=1").count() == 1
    tables.write_reviews(spark.range(1).select(F.lit(5).alias("risk_score")), f"{tmp_path}/r")
    assert spark.read.json(f"{tmp_path}/r").first().risk_score == 5


def test_tables_and_settings(spark):
    spark.sql("create database if not exists corpus_test")
    tables.create_tables(spark, "corpus_test")
    tables.create_tables(spark, "corpus_test")
    assert {r.tableName for r in spark.sql("show tables in corpus_test").collect()} == set(tables.TABLES)
    spark.sql("insert into corpus_test.legal_relation values (1, 2, 'amends'), (1, 2, 'amends'), (2, 3, 'repeals')")
    assert [r["count"] for r in tables.conflicts(spark.table("corpus_test.legal_relation"), "legal_relation").collect()] == [2]
    spark.sql("drop database corpus_test cascade")
    spark.conf.set("spark.docugrain.result_limit", "3")
    provisions = spark.createDataFrame([(f"p{k}", "faiz", ["x"]) for k in range(9)], "id string, words string, keywords array<string>")
    found = lambda: corpus.retrieve(spark.createDataFrame([(1, "faiz")], "doc int, text string"), provisions, "doc", "text", "id", "keywords", "words", F.lit(True)).count()
    events = spark.createDataFrame([(1, "2024-01-01 00:00:00")] * 9, "d int, t string").withColumn("ts", F.col("t").cast("timestamp"))
    assert found() == 3 and state.hourly(events, "d", "ts").first().allowed == 5
    spark.conf.set("spark.docugrain.audit_rate_limit_per_hour", "7")
    assert state.hourly(events, "d", "ts").first().allowed == 7
    spark.conf.unset("spark.docugrain.audit_rate_limit_per_hour")
    assert tables.Settings.of(spark).result_limit == 3 and tables.Settings.of(spark).max_pdf_bytes == 15_728_640
    spark.conf.unset("spark.docugrain.result_limit")
    assert found() == 8


def test_cache_renews_on_a_miss_only(spark):
    at = lambda m: f"2024-01-01 00:{m:02d}:00"
    rows = [("a", 1, at(0)), ("a", 2, at(4)), ("a", 3, at(8)), ("a", 4, at(12)), ("a", 5, at(13)), ("b", 6, at(4)), ("a", 7, at(0)), ("b", 8, at(9))]
    got = {r.event_id: r.hit for r in state.cache_hits(spark.createDataFrame(rows, "device string, event_id int, t string").withColumn("ts", F.col("t").cast("timestamp")), "device", "ts", "event_id").collect()}
    assert got == {1: False, 7: True, 2: True, 3: False, 4: True, 5: False, 6: False, 8: False}
    assert state.cache_hits(spark.createDataFrame([], "device string, event_id int, ts timestamp"), "device", "ts", "event_id").count() == 0


@pytest.mark.parametrize(("events", "want"), [
    ([(1, "PENDING", False), (2, "PROCESSING", False), (3, "PROCESSING", True), (4, "DONE", False)], "FAILED"),
    ([(1, "PENDING", False), (2, "PENDING", True), (3, "PROCESSING", False)], "PROCESSING"),
    ([(1, "PROCESSING", False), (2, "DONE", False), (3, "DONE", False)], "DONE"),
    ([(1, "PROCESSING", False), (2, "DONE", True)], "DONE"),
    ([(1, "PROCESSING", True), (2, "FAILED", False)], "FAILED"),
    ([(1, "DONE", False), (2, None, True)], "DONE"),
    ([(1, "DONE", False), (2, None, True), (3, "DONE", False)], "DONE"),
    ([(1, "PROCESSING", False), (2, None, True), (3, "DONE", False), (4, "DONE", False)], "FAILED"),
    ([(1, None, True)], None),
])
def test_the_cancel_flag_is_read_when_the_work_ends(spark, events, want):
    rows = spark.createDataFrame([(7, *e) for e in events], "job int, at int, status string, cancel boolean")
    assert state.job_state(rows, "job", F.col("status"), F.col("cancel"), ["at"]).first().status == want


def test_retrieval_of_provisions(spark):
    rows = [("p1", "Faiz", "Akdi faiz oranı hesap özetinde yer alır.", ["asgari ödeme", "FAİZ"], None), ("p2", "Sigorta", "Poliçe primi.", ["sigorta"], None), ("p3", "Kredi", "Kredi kartı faiz oranı.", ["gecikme"], "REPEALED"), ("p4", "Genel", "Başka.", None, "ACTIVE")]
    provisions = spark.createDataFrame(rows, "id string, title string, text string, keywords array<string>, status string").withColumn("words", F.concat_ws(" ", "title", "text"))
    asked = [(1, "Kredi kartı akdi faiz oranı, gecikme faizi ve asgari ödeme tutarı hesap özetinde yer alır."), (2, "xyz"), (3, None), (4, "ﬁnans \uff26\uff21\u0130\uff3a")]
    valid = corpus.active_on(F.col("status"), F.lit(None), F.lit(None), F.current_date())
    got = {}
    for r in corpus.retrieve(spark.createDataFrame(asked, "doc int, text string"), provisions, "doc", "text", "id", "keywords", "words", valid, 2).collect():
        got.setdefault(r.doc, []).append((r.place, r.id, r.score))
    assert got[1] == [(1, "p1", 4 + 4 + 7)] and got[2] == got[3] == [(1, "p1", 0.0), (2, "p2", 0.0)] and got[4] == [(1, "p1", 5.0)]


def test_cover_density():
    words = "a b x a x x b".split()
    # Stretches: (a b) at once, (b x a) with one between, (a x x b) with two between.
    assert corpus.cover_density(words, {"a", "b"}, 0) == pytest.approx(0.4 + 0.4 / 2 + 0.4 / 3)
    assert corpus.cover_density(words, {"a", "b"}, 1) == pytest.approx(2 / (1 + 2.5) + 0.4 / 2 + 0.4 / 3)
    assert corpus.cover_density(words, {"a", "z"}, 0) == 0 and corpus.cover_density(words, {"x"}, 0) == pytest.approx(1.2)


def test_nearest_by_blocks(spark):
    rows = [(k, [float((k * 7) % 5), float(k % 3), 1.0] if k != 4 else [0.0, 0.0, 0.0]) for k in range(30)] + [(99, None)]
    v = spark.createDataFrame(rows, "id long, e array<float>")
    norm = {k: [x / max(1e-300, sum(y * y for y in e) ** 0.5) for x in e] for k, e in rows if e}
    for block in (2, 100):
        got = corpus.nearest(v.where("id % 5 = 0"), v, "id", "e", 3, block).collect()
        for q in range(0, 30, 5):
            want = sorted(((-round(sum(a * b for a, b in zip(norm[q], norm[k], strict=True)), 9), k) for k in norm if k != q))[:3]
            assert [(-round(r.similarity, 9), r.id) for r in sorted((r for r in got if r.query == q), key=lambda r: r.place)] == want


def chunk_loop(text, cap):
    import re

    if text is None or len(text) <= cap:
        return [text or ""]
    starts = [m.start() for m in re.finditer(r"\[REPORT PAGE \d+\]", text)]
    if len(starts) <= 1:
        return [text[k : k + cap] for k in range(0, len(text), cap)]
    out, begin = [], 0
    for k, at in enumerate(starts):
        end = starts[k + 1] if k + 1 < len(starts) else len(text)
        if end - begin > cap and at > begin:
            out.append(text[begin:at])
            begin = at
    return [*out, text[begin:]]


def test_chunks_equal_a_plain_loop(spark):
    import random

    rnd, texts = random.Random(4), [None, "", "x" * 100, "x" * 101, "[REPORT PAGE 1]" + "y" * 300, "a" * 250 + "[REPORT PAGE 1]b[REPORT PAGE 2]" + "c" * 90]
    texts += ["p" * rnd.randrange(0, 150) + "".join(f"[REPORT PAGE {k}]" + "z" * rnd.randrange(0, 140) for k in range(rnd.randint(0, 9))) for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", pages.text_chunks(F.col("text"), 100).alias("chunks"))
    assert {r.id: r.chunks for r in rows.collect()} == {k: chunk_loop(t, 100) for k, t in enumerate(texts)}


def test_nfkc_equals_the_standard_library(spark):
    import unicodedata

    from docugrain.functions import text as X

    for t in ("ﬁnans ２０２４ İIıi", "Ｆａｉｚ ½ ①", ""):
        row = spark.createDataFrame([(t,)], "t string").select(X.lower_tr(X.nfkc()(F.col("t"))).alias("x")).first()
        assert row.x == unicodedata.normalize("NFKC", t).replace("İ", "i").replace("I", "ı").lower() == corpus.normalised(t)


REPLY = {
    "risk_score": 40, "score_rationale": "Oran %90,1. Makul.", "summary": "TMS. Oran %90,1. Kalan iyi.",
    "risks": [{"title": "Kur riski", "severity": "HIGH", "finding": "f1", "evidence": "Kur farkı [REPORT PAGE 2] [REPORT PAGE 9]"}, {"title": "Yabancı", "severity": "LOW", "finding": "f2", "evidence": "Oran %90,1"}, {"title": "Sayı", "severity": "low", "finding": "f3", "evidence": "Tutar 4.321,5 (Sayfa 7)"}],
    "recommendations": ["r1"], "key_metrics": [{"label": "Kâr", "value": "(2.609,7) (2.917,3) %11,8", "note": None}, {"label": "Oran", "value": "%90,1", "note": ""}, {"label": "kar", "value": "1,5", "note": ""}],
    "advisor_questions": ["Oran %90,1 neden?", "Ne zaman?"], "references": [{"source": "S", "article": "1", "title": "t"}, {"source": "Z", "article": "1", "title": "t"}],
}


def test_whole_review(spark):
    text = "[REPORT PAGE 1]\nTMS hukumlerine uygun\nTutar 4.321,5\n[REPORT PAGE 2]\nUFRS esaslarina dayanan\noran %90,1\n"
    schema = "doc int, text string, language string, document_type string, context array<struct<source:string,article:string,title:string>>, total_pages int, included_pages int"
    rows = spark.createDataFrame([(1, text, "tr", "rental", [("S", "1", "T1"), ("Y", "2", "T2")], 2, 2), (2, text, "en", None, [("Y", "2", "T2")], 2, 2), (3, text, "tr", None, None, 2, 2)], schema)
    reply = lambda prompt, answer=json.dumps(REPLY): answer
    got = {r.doc: r.review for r in review.audit(rows, call=reply).collect()}
    a = got[1]
    assert [(x.title, x.evidence) for x in a.risks] == [("Kur riski", "Kur farkı (Sayfa 2)"), ("Sayı", "Tutar 4.321,5 (Sayfa 1)")]
    assert a.risk_score == 54 and a.summary == "TMS. Kalan iyi." and a.score_rationale == "Makul." and a.advisor_questions == ["Ne zaman?"]  # 100 - 28 - 3, at most 54 with a grave one
    assert [(m.label, m.value) for m in a.key_metrics] == [("Kâr", "2.917,3 (%11,8)")] and a.recommendations == ["r1"]
    assert [x.source for x in a.references] == ["S"] and [x.source for x in got[2].references] == ["Y"] and [x.source for x in got[3].references] == ["Rapor Sayfa 1", "Rapor Sayfa 2"]
    # In chunks of one page each the reviews are merged and a note goes before the summary.
    b = {r.doc: r.review for r in review.audit(rows.withColumn("total_pages", F.lit(5)), call=reply, chunk=90).collect()}[2]
    assert b.summary == "Note: The first 2 of 5 pages were reviewed across 2 sections; the remaining pages are not included. TMS. Kalan iyi."
    assert b.score_rationale == "1 high and 0 medium severity attention points were identified across the document." and [x.title for x in b.risks] == ["Kur riski", "Sayı"]


def test_merged_reviews(spark):
    risk = lambda title, severity: (title, severity, "f", "e")
    parts = [(1, 0, (10, "x", " ", [risk("A", "LOW"), risk("B", "HIGH")], ["r", "s"], [("l", str(k), "") for k in range(4)], ["q1", "q2"], [])), (1, 1, (30, "y", "Second.", [risk(" a ", "MEDIUM"), risk("C", None)], ["s", "t"], [("l", str(k), "") for k in range(4)], [f"q{k}" for k in range(2, 9)], None)), (1, 2, (None, None, None, None, None, None, None, None))]
    rows = spark.createDataFrame(parts, f"doc int, seq int, review struct<{review._fields()}>")
    r = findings.merge_reviews(rows, "doc", "seq", "review", F.lit(False)).first().response
    assert [x.title for x in r.risks] == ["B", " a ", "C"] and r.risk_score == 30 and r.summary == "Second." and r.recommendations == ["r", "s", "t"]
    assert [m.value for m in r.key_metrics] == ["0", "1", "2", "3", "0", "1"] and r.advisor_questions == ["q1", "q2", "q3", "q4"]
    assert r.score_rationale.startswith("1 high and 1 medium")


def test_full_text_query_equals_plain_loops(spark):
    import re

    from docugrain.plans import catalog

    at = "/root/testdata/sf0.001"
    items = {r.item_id: r.text for r in spark.read.parquet(f"{at}/benchmark.parquet").collect()}
    split = lambda t: re.findall(r"[^\W_]+", t.lower())
    want = {}
    for q, text in items.items():
        found = re.findall(r"[^\W_]+", text)
        asked = {found[0].lower(), found[-1].lower()}
        hits = []
        for i, t in items.items():
            title = t.split()[0]
            words = split(title) + split(t)
            if asked <= set(words):
                hits.append((-corpus.cover_density(words, asked, len(split(title))), i % 2 == 0, i))
        # Order is by item_id % 2 <> 0, false first.
        want[q] = [(k + 1, i) for k, (_, _, i) in enumerate(sorted(((r, i % 2 != 0, i) for r, _, i in hits))[:8])]
    got = {}
    for r in catalog.full_text_rank(spark, at).collect():
        got.setdefault(r["query"], []).append((r.place, r.item_id))
    assert {q: sorted(v) for q, v in got.items()} == {q: v for q, v in want.items() if v}


def test_prompts_with_context(spark):
    rows = spark.createDataFrame([(1, "text", "rental", "en", [("S", "1", "T")]), (2, "text", None, "tr", [])], "doc int, text string, document_type string, language string, context array<struct<source:string,article:string,title:string>>")
    got = {r.doc: r.prompt for r in reviewer.prompts(rows, "doc", context="context").collect()}
    assert "S - 1 - T" in got[1] and got[1].endswith("text") and "Provisions" not in got[2]
    assert reviewer.TASKS["rental"] in got[1] and reviewer.TASKS["financial"] in got[2] and "Türkçe" in got[2] and "Türkçe" not in got[1]
    from docugrain.functions import text as X

    assert set(X.DOCUMENT_TYPES) | {"financial"} == set(reviewer.TASKS)


def audit_loop(text, tr, turns, chunk):
    """What audit_conversations makes of one document, and how many calls it takes."""
    import re

    from docugrain.plans import catalog

    order = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}
    parts = [json.loads(catalog.plain_reviewer("head\n\n" + c)) for c in chunk_loop(text, chunk)]
    said = [p["summary"] for p in parts if p["summary"].strip()]
    risks = [r for p in parts for r in p["risks"]]
    calls = len(parts)
    if len(parts) > 1:
        risks, seen = sorted(risks, key=lambda r: -order[r["severity"]]), set()
        risks = [r for r in risks if not (r["title"].lower() in seen or seen.add(r["title"].lower()))][:8]
        summary = said[0] if said else ""
        if len(said) > 1:
            calls += 1
            summary = catalog.plain_merger("task\n\n" + "\n---\n".join(said)).strip() or summary
        note = f"Not: {turns} sayfalık belge {len(parts)} bölüme ayrılarak bütünüyle incelenmiştir. " if tr else f"Note: This {turns}-page document was reviewed in full across {len(parts)} sections. "
        summary, recommendations, questions = note + summary, list(dict.fromkeys(x for p in parts for x in p["recommendations"]))[:6], list(dict.fromkeys(x for p in parts for x in p["advisor_questions"]))[:4]
    else:
        summary, recommendations, questions = parts[0]["summary"], parts[0]["recommendations"], parts[0]["advisor_questions"]
    n = [sum(order[r["severity"]] == k for r in risks) for k in (4, 3, 2, 1)]
    raw = max(0, min(100, 100 - 45 * n[0] - 28 * n[1] - 8 * n[2] - 3 * n[3]))
    score = min(29, raw) if n[0] else max(30, min(54, raw)) if n[1] else max(55, min(79, raw)) if n[2] else max(80, raw)
    page = lambda r: int(re.search(r"\d+", r["evidence"])[0])
    cited = [[r["title"], r["severity"], r["finding"], f"{r['title']} ({'Sayfa' if tr else 'Page'} {page(r)})"] for r in risks]
    references = [("Rapor Sayfa " if tr else "Report Page ") + str(p) for p in sorted({page(r) for r in risks})]
    why = f"Belge genelinde {n[0] + n[1]} yüksek ve {n[2]} orta önem düzeyinde dikkat noktası tespit edilmiştir." if tr else f"{n[0] + n[1]} high and {n[2]} medium severity attention points were identified across the document."
    return [score, why, summary, cited, "|".join(recommendations), "|".join(questions), "|".join(references)], calls


def test_an_audit_of_conversations_equals_a_plain_loop_and_asks_once(spark, tmp_path):
    from docugrain.plans import catalog

    (tmp_path / "calls").mkdir()
    at, folder = "/root/testdata/sf0.001", str(tmp_path / "calls")
    turns = {}
    for r in spark.read.parquet(f"{at}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append(f"\n\n[REPORT PAGE {r.turn + 1}]\n{r.text or ''}")
    want = {c: audit_loop("".join(t), c % 2 == 0, len(t), 2000) for c, t in turns.items()}
    counted = {}
    for name in ("plain_reviewer", "plain_merger"):
        plain = counted[name] = getattr(catalog, name)

        def call(prompt, plain=plain):
            import uuid

            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(prompt)
            return plain(prompt)

        setattr(catalog, name, call)
    try:
        got = {r.conv_id: [r.risk_score, r.score_rationale, r.summary, [list(x.values()) for x in json.loads(r.risks)], r.recommendations, r.advisor_questions, r.references] for r in catalog.audit_conversations(spark, at).collect()}
    finally:
        for name, plain in counted.items():
            setattr(catalog, name, plain)
    assert got == {c: w for c, (w, _) in want.items()}
    assert len(list((tmp_path / "calls").iterdir())) == sum(n for _, n in want.values())
    assert any(n > 3 for _, n in want.values())


def test_summaries_merge_in_a_tree_and_fall_back(spark):
    rows = spark.createDataFrame([(1, k, f"s{k}", False) for k in range(7)] + [(2, 0, " ", True), (2, 1, "only", True), (3, 0, "bad", True), (3, 1, "x", True), (4, 0, None, False)], "doc int, seq int, summary string, tr boolean")

    def merge(prompt):
        body = prompt.split("\n\n", 1)[1]
        if "bad" in body:
            raise ValueError
        return f" <{body.replace(reviewer.SEPARATOR, '+')}>\n"

    got = {r.doc: r.summary for r in reviewer.synthesize(rows, "doc", "seq", "summary", "tr", merge).collect()}
    assert got == {1: "<s0+s1+s2+s3+s4+s5+s6>", 2: "only", 3: "bad"}
    tree = {r.doc: r.summary for r in reviewer.synthesize(rows, "doc", "seq", "summary", "tr", merge, 40).collect()}
    assert tree[1] == "<<s0+s1+s2+s3+s4>+<s5+s6>>"


def test_two_writers_of_usage_lose_no_count_and_leave_other_months(spark, tmp_path):
    import os
    import threading

    path, batch = f"{tmp_path}/u", lambda *rows: spark.createDataFrame(list(rows), "device string, month string")
    tables.upsert_usage(batch(("a", "2024-01"), ("a", "2024-02"), ("b", "2024-02"), ("c", None)), path, "device")
    untouched = {f: os.stat(f"{path}/month=2024-01/v=1/{f}").st_mtime_ns for f in os.listdir(f"{path}/month=2024-01/v=1")}
    failed = []

    def write(k):
        try:
            tables.upsert_usage(batch(("a", "2024-02"), (f"n{k}", "2024-02"), (f"n{k}", "2024-03")), path, "device")
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    held = {(r.device, r.month): r.used_count for r in tables.upsert_usage(batch().limit(0), path, "device").collect()}
    assert held == {("a", "2024-01"): 1, ("a", "2024-02"): 5, ("b", "2024-02"): 1, **{(f"n{k}", m): 1 for k in range(4) for m in ("2024-02", "2024-03")}}
    assert {f: os.stat(f"{path}/month=2024-01/v=1/{f}").st_mtime_ns for f in os.listdir(f"{path}/month=2024-01/v=1")} == untouched
    assert sorted(n for n in os.listdir(f"{path}/month=2024-02") if n.startswith("v=")) == ["v=4", "v=5"] and not [n for n in os.listdir(path) if n.startswith("_staging")]
    # A claim of a writer that is gone is passed over once its lease is over.
    open(f"{path}/month=2024-01/_claim-2", "w").close()
    tables.upsert_usage(batch(("a", "2024-01")), path, "device", lease=0.5)
    assert {r.used_count for r in tables.usage_table(spark, path, tables.upsert_usage(batch().limit(0), path, "device").schema).where("month = '2024-01'").collect()} == {2}


def test_table_functions_in_sql(spark):
    from docugrain.functions import sql

    sql.register(spark)
    texts = [None, "", "plain " * 40, "x[REPORT PAGE 1]a[REPORT PAGE 12]b[REPORT PAGE 1]c", "[REPORT PAGE 3]" + "y" * 300, "p" * 90 + "".join(f"[REPORT PAGE {k}]" + "z" * (30 * k) for k in range(1, 8))]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows.createOrReplaceTempView("marked")
    got = {}
    for r in spark.sql("select id, c.seq, c.chunk from marked, lateral text_chunks(text, 100) c").collect():
        got.setdefault(r.id, {})[r.seq] = r.chunk
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == {k: chunk_loop(t, 100) for k, t in enumerate(texts)}
    split = {(r.id, r.page): r.body for r in spark.sql("select id, p.page, p.body from marked, lateral split_pages(text) p").collect()}
    assert split == {(r.id, r.page): r.body for r in pages.split_pages(rows, "id").collect()} and split[3, 1] == "c"
    many = spark.createDataFrame([(d, p, "t" * (p * 10)) for d in range(5) for p in range(1, 9)], "doc int, page int, text string")
    many.repartition(7).createOrReplaceTempView("many")
    capped = spark.sql("select * from page_cap(table(many), 150)").collect()
    assert {tuple(r) for r in capped} == {(r.doc, r.page, r.text) for r in pages.page_cap(many, "doc", "page", "text", 150).collect()}
    with pytest.raises(Exception, match="three columns"):
        spark.sql("select * from page_cap(table(select doc from many), 150)").collect()
