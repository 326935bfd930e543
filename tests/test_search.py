"""Web-search queries against plain loops."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from docugrain.operators import search
from docugrain.plans import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("query", "want"), [
    ("a b", [(0, False, ["a"]), (0, False, ["b"])]),
    ('"Faiz oranı" or KREDİ -kart', [(0, False, ["faiz", "oranı"]), (1, False, ["kredi"]), (1, True, ["kart"])]),
    ('a or b or "c d" -"e f"', [(0, False, ["a"]), (1, False, ["b"]), (2, False, ["c", "d"]), (2, True, ["e", "f"])]),
    ("or a or", [(0, False, ["or"]), (0, False, ["a"]), (0, False, ["or"])]),
    ("a or or b", [(0, False, ["a"]), (1, False, ["or"]), (1, False, ["b"])]),
    ('law-no 5 "open', [(0, False, ["law", "no"]), (0, False, ["5"]), (0, False, ["open"])]),
    ("a -or b", [(0, False, ["a"]), (0, True, ["or"]), (0, False, ["b"])]),
    ("", []), (None, []), (" - . ", []),
])
def test_syntax(query, want):
    assert search.parse(query) == want


def plain_rank(words, titles, alternatives):
    """Cover density, from every stretch of the asked words."""
    asked = {t for a in alternatives for p in a for t in p}
    at = [k for k, w in enumerate(words) if w in asked]

    def holds(i, j):
        inside = lambda p: any(at[i] <= s and s + len(p) - 1 <= at[j] and words[s : s + len(p)] == p for s in at)
        return any(all(inside(p) for p in a) for a in alternatives)

    total = 0.0
    for i in range(len(at)):
        for j in range(i, len(at)):
            if holds(i, j) and not (j > i and (holds(i + 1, j) or holds(i, j - 1))):
                inverse = sum(1 / (1.0 if at[k] < titles else 0.4) for k in range(i, j + 1))
                total += (j - i + 1) / inverse / (1 + at[j] - at[i] - (j - i))
    return total


def plain_search(queries, items, k=8):
    """items: id to (title, text, order)."""
    out = {}
    for q, asked in queries.items():
        hits = []
        for i, (title, text, order) in items.items():
            head = search.terms_of(title)
            words = head + search.terms_of(text)
            has = lambda p: any(words[s : s + len(p)] == p for s in range(len(words)))
            groups = {}
            for a, excluded, terms in search.parse(asked):
                groups.setdefault(a, []).append((excluded, terms))
            good = [[t for x, t in g if not x] for g in groups.values() if any(not x for x, _ in g) and all(has(t) != x for x, t in g)]
            if good:
                hits.append((-round(plain_rank(words, len(head), good), 9), *order, i))
        out[q] = [(n + 1, h[-1], -h[0]) for n, h in enumerate(sorted(hits)[:k])]
    return {q: v for q, v in out.items() if v}


def gathered(rows):
    got = {}
    for r in rows:
        got.setdefault(r["query"], []).append((r.place, r.id, round(r["rank"], 9)))
    return {q: sorted(v) for q, v in got.items()}


def test_search_equals_plain_loops(spark):
    import random

    rnd = random.Random(8)
    items = {i: (" ".join(rnd.choices("abc", k=rnd.randint(0, 2))), " ".join(rnd.choices("abcdefgh", k=rnd.randint(0, 25))), (i % 3,)) for i in range(60)}
    forms = ["a", "a b", '"a b"', '"a b c" or d', "a or b c", "a -b", '"a b" -"c d"', "h or g -a", '"a a"', "x", "-a", "a-b c", 'a "b a"', "", "a or -b", '"e f" e']
    rows = spark.createDataFrame([(i, t, x, o[0]) for i, (t, x, o) in items.items()], "id int, title string, text string, o int")
    asked = spark.createDataFrame(list(enumerate(forms)) + [(99, None)], "query int, asked string")
    got = search.search(asked, "query", "asked", search.postings(rows, "id", ["title"], "text"), rows, "id", [F.col("o")], 5)
    assert gathered(got.collect()) == plain_search(dict(enumerate(forms)), items, 5)


def test_registered_search_equals_plain_loops(spark):
    day = datetime.date(2024, 1, 1)
    rows = catalog._regulations(spark, SMALL).collect()
    valid = {r.id: (r.title, r.text, (not r.verified, -(r.effective_from - datetime.date(1970, 1, 1)).days if r.effective_from else 1 << 30)) for r in rows if r.status == "ACTIVE" and (r.effective_from is None or r.effective_from <= day) and (r.effective_to is None or r.effective_to >= day)}
    assert 0 < len(valid) < len(rows)
    asked = {}
    for r in rows:
        w = [x for x in re.split(r"[\W_]+", r.text) if x]
        at = lambda k, w=w: w[k] if len(w) > k else "none"
        asked[r.id] = [f"{w[0]} {w[-1]}", f'"{at(2)} {at(3)}"', f'{w[0]} or "{at(1)} {at(2)}" {at(4)}', f"{at(1)} -{at(3)}", f'{w[-1]} -"{w[0]} {at(1)}"'][r.id % 5]
    got = gathered(catalog.web_search(spark, SMALL).collect())
    assert got == plain_search(asked, valid) and len(got) >= len(rows) // 2


def test_postings_can_be_kept(spark, tmp_path):
    rows = spark.createDataFrame([(1, "T", "faiz oranı faiz"), (2, None, None)], "id int, title string, text string")
    search.postings(rows, "id", ["title"], "text").write.parquet(f"{tmp_path}/postings")
    kept = spark.read.parquet(f"{tmp_path}/postings")
    assert sorted((r.term, r.id, r.pos, r.title) for r in kept.collect()) == [("faiz", 1, 1, False), ("faiz", 1, 3, False), ("oranı", 1, 2, False), ("t", 1, 0, True)]
    asked = spark.createDataFrame([(7, '"oranı faiz"')], "q int, asked string")
    assert [(r.q, r.id) for r in search.search(asked, "q", "asked", kept, rows, "id", []).collect()] == [(7, 1)]
