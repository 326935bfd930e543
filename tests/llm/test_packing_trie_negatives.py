"""Operators 11 to 13 against plain versions, and their defined results on odd input."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docugrain.llm import byte_words, conversation_trie, hard_negatives, packing

SMALL = "/root/testdata/sf0.001"
CLASHES = ("id", "queue", "bucket", "rank", "place", "block", "path", "total", "x", "part", "at", "hash", "ids", "score", "other")


def library():
    return Tokenizer.from_file(P.path(packing.VOCABULARY))


# --- 11 packing
@pytest.fixture(scope="module")
def encoder():
    return byte_words.ByteWords(packing.VOCABULARY, packing.RANKS)


def test_words_of_a_byte_vocabulary_encode_like_the_library(encoder):
    rng, parts = random.Random(3), ["a", "B", " ", "  ", "\n", "\t", "'s", "'", "12", "é", "\xa0", "　", "漢", "😀", "<|endoftext|>", "́", "word", "\x1c", "\x85", ",", "...", " ", "\r\n", "ǆ", "˿"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(8000)] + ["", "x" * 60_000, "word " * 20_000]
    ids, sizes = encoder.encode(pa.array(texts), 1)
    want = [[*e.ids, 1] for e in library().encode_batch(texts, add_special_tokens=False)]
    assert sizes.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_every_id_has_one_place_whatever_the_targets():
    rng = random.Random(1)
    for trial in range(400):
        tokens = [rng.choice([0, 1, 5, rng.randint(0, 3000)]) for _ in range(rng.randint(1, 6))]
        window = rng.choice([8, 64, 512])
        try:
            phases = packing.schedule(tokens, tokens if trial % 2 else [rng.choice([0, 1, 2, 5]) for _ in tokens], window)
        except ValueError:
            continue
        seen = np.zeros(sum(tokens), int)
        for q, n in enumerate(tokens):
            j = 0
            while j < n:
                m = min(n - j, rng.randint(1, 200))
                for a, b in packing.places(phases, q, j, m):
                    seen[a : a + b] += 1
                j += m
        assert (seen == 1).all()


def test_deficits_stay_below_one_id_in_every_window():
    tokens, window = [70_001, 20_003, 9_996], 1000
    (phase,) = packing.schedule(tokens, tokens, window)
    for q, n in enumerate(tokens):
        for i in range(phase.length // window):
            assert abs(phase.given(q, i * window) - i * window * n / sum(tokens)) < 1


def check_pieces(rows, want):
    """rows: pieces with ids; want: doc_id to the ids of its rows."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) > 0
    assert set(by_doc) == set(want)
    for i, all_ids in want.items():
        if len(all_ids) == 1:
            got = sorted(by_doc[i], key=lambda r: r.start)
            assert [x for r in got for x in r.ids] == all_ids[0] and {r.doc_tokens for r in got} == {len(all_ids[0])}
            assert [r.start for r in got] == [sum(x.length for x in got[:k]) for k in range(len(got))]
        else:
            assert sum(r.length for r in by_doc[i]) == sum(map(len, all_ids))
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
    return {s: sum(r.length for r in p) for s, p in by_sequence.items()}


def test_packing_holds_every_id_once_without_padding(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    tk = library()
    want = {r.doc_id: [[*tk.encode(r.text or "", add_special_tokens=False).ids, 1]] for r in docs.collect()}
    lengths = check_pieces(packing.pack(docs, packing.Mix(bucket=5000), with_ids=True).collect(), want)
    assert set(lengths) == set(range(len(lengths)))
    assert all(n == 2048 or n & (n - 1) == 0 for n in lengths.values()) and sum(n < 2048 for n in lengths.values()) <= 11
    plain = packing.op11_packing(spark, SMALL)
    assert [f"{f.name} {f.dataType.simpleString()}" for f in plain.schema][:7] == ["doc_id bigint", "start bigint", "length bigint", "ids_crc32 bigint", "doc_tokens bigint", "sequence_id bigint", "offset bigint"]


def test_windows_hold_the_target_mixture_until_a_queue_is_empty(spark):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("source"), F.repeat(F.lit("word "), F.lit(40)).alias("text"))
    how = packing.Mix(sequence=64, window=4, bucket=500, targets={"a": 0.5, "b": 0.25, None: 0.25})
    rows = packing.pack(docs, how).collect()
    windows = defaultdict(Counter)
    for r in rows:
        windows[r.sequence_id // 4][r.queue] += r.length
    total = sum(r.length for r in rows)
    a = sum(r.length for r in rows if r.queue == 1)
    for w in range(2 * a // 256 - 1):  # queue 0: null, 1: a, 2: b
        assert abs(windows[w][1] - 128) <= 1 and abs(windows[w][0] - 64) <= 1 and sum(windows[w].values()) == 256
    for w in range(2 * a // 256 + 1, total // 256):
        assert windows[w][1] == 0 and abs(windows[w][0] - 128) <= 1
    with pytest.raises(ValueError):
        packing.pack(docs, packing.Mix(sequence=4, window=1, targets={"a": 1.0, "b": 0.001})).collect()


def test_a_source_with_hardly_any_ids_is_packed_too(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 7, "small").when(F.col("id") % 3 == 0, "b").otherwise("a").alias("source"), F.repeat(F.lit("word "), F.when(F.col("id") == 7, 0).otherwise(20).cast("int")).alias("text"))
    rows = packing.pack(docs, packing.Mix(sequence=16, window=4)).collect()
    assert len({r.doc_id for r in rows}) == 400 and len({r.queue for r in rows}) == 2
    assert sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values())


def test_packing_of_odd_rows(spark):
    texts = [(1, None, None), (2, "", "s"), (3, " \n\t ", "s"), (4, "one", "t"), (4, "one", "t"), (None, "no id", "t"), (6, "x" * 50_000, "s"), (7, "word  " * 9_000, ""), (8, "é 日本 <|endoftext|> 🙂", "s")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in CLASHES})
    tk, want = library(), defaultdict(list)
    for i, t, _ in texts:
        want[i].append([*tk.encode(t or "", add_special_tokens=False).ids, 1])
    check_pieces(packing.pack(docs, with_ids=True).collect(), want)
    assert packing.pack(docs.limit(0)).collect() == []


# --- 12 conversation trie
def plain_trie(rows, family=5, heads=9):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            conv[c].append(((t is not None, t or 0), r or "", x or ""))
    conv = {c: [(r, x) for _, r, x in sorted(v)] for c, v in conv.items()}
    new = {}
    for c, v in conv.items():
        h = zlib.crc32(str(c).encode()) % heads
        new[c] = conv.get(c - int(math.fmod(c, family)), [])[:h] + v[h:]
    members, children = defaultdict(list), defaultdict(list)
    for c, v in new.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    rolled, out = {}, []
    for k in sorted(members, key=len, reverse=True):
        below = [rolled[x] for x in children[k]]
        saved = (len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0
        rolled[k] = (sum(x[0] for x in below) or 1, saved + sum(x[1] for x in below))
        ends = ",".join(str(c) for c in sorted(members[k]) if len(new[c]) == len(k))
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(children[k]), *rolled[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda x: x[:2])


@pytest.mark.parametrize("bits", [64, 3])
def test_trie_equals_a_plain_one_with_collisions_too(spark, bits):
    rng, rows = random.Random(5), []
    for c in range(-3, 30):
        if c != 20:  # the head of 21 to 24
            rows += [(c, rng.choice([None, t, t]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", "é", None])) for t in range(rng.randint(1, 12))]
    # A conversation that lies in many partitions, repeated rows, one without id, and many equal conversations.
    rows += [(41, t % 900, "u", str(t % 7)) for t in range(4500)] + rows[:5] + [(None, 1, "u", "x")] + [(c, t, "u", "same") for c in range(100, 160) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5).withColumns({c: F.lit(1) for c in CLASHES})
    got = conversation_trie.trie(df, conversation_trie.Trie(bits=bits)).collect()
    assert sorted((tuple(r) for r in got), key=lambda x: x[:2]) == plain_trie(rows)


def test_query_of_the_trie(spark):
    got = conversation_trie.op12_conversation_trie(spark, SMALL)
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in got.collect()), key=lambda x: x[:2]) == plain_trie(rows)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint"] * 7 + ["string"]
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_trie.trie(none).collect() == []


def test_conversations_without_rebuilding(spark):
    rows = [(c, t, "u", "same" if t < 2 else str(c)) for c in range(12) for t in range(c % 4)]
    got = conversation_trie.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), conversation_trie.Trie(heads=1))
    assert sorted((tuple(r) for r in got.collect()), key=lambda x: x[:2]) == plain_trie(rows, heads=1)


def test_scan_over_batches_is_one_polynomial():
    rng = np.random.default_rng(2)
    convs, hashes = np.sort(rng.integers(0, 9, 400)), rng.integers(0, 2**63, 400, dtype=np.uint64)
    scan, sums, places = conversation_trie.Scan(), [], []
    for k in range(0, 400, 37):
        p, s = scan.add(convs[k : k + 37], hashes[k : k + 37])
        places += p.tolist()
        sums += s.tolist()
    now, total = None, 0
    for c, h, p, s in zip(convs, hashes.tolist(), places, sums, strict=True):
        at, total = (at + 1, total) if c == now else (1, 0)
        now, total = c, (total + h * pow(conversation_trie.BASE, at, 1 << 64)) % (1 << 64)
        assert (p, s) == (at, total)


# --- 13 hard negatives
def plain_negatives(rows, every=50):
    rows = {i: (label, v) for i, label, v in sorted(rows, key=lambda r: (r[0], -r[1], [-x for x in r[2]]))}  # of equal ids the least stays
    ints = {i: [math.floor(256 * x) for x in v] for i, (_, v) in rows.items()}
    out = []
    for a in rows:
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(ints[a], v, strict=False)) for i, v in ints.items()}
        order = sorted(rows, key=lambda i: (-score[i], i))
        for p in [i for i in order if i != a and rows[i][0] == rows[a][0]][:5]:
            fit = [i for i in order if rows[i][0] != rows[a][0] and 50 * score[p] <= 100 * score[i] <= 95 * score[p]][:3]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("size", [3, 100, 10**6, 2**40, 2**61])
def test_intervals_drop_nothing_that_qualifies(size):
    rng = np.random.default_rng(size % 97)
    for trial in range(60):
        na, n, d, k = rng.integers(1, 6), rng.integers(1, 60), rng.integers(0, 6), int(rng.integers(1, 5))
        a, r = rng.integers(-size, size + 1, (na, d)), rng.integers(-size, size + 1, (n, d))
        planes, image = hard_negatives.to_planes(r)
        sliced = hard_negatives.from_planes(image, planes, n, d)
        allowed, ids, scores = rng.random((na, n)) < 0.8, rng.permutation(n), a.astype(object) @ r.T.astype(object) if d else np.zeros((na, n), object)
        first = lambda i, js: sorted(js, key=lambda j: (-scores[i, j], ids[j]))[:k]
        got = hard_negatives.mine(a, sliced, allowed, ids, k, None, [0, 0.1, 1][trial % 3])
        assert sorted(got) == sorted((i, 0, int(j), int(scores[i, j])) for i in range(na) for j in first(i, np.flatnonzero(allowed[i])))
        if size < 2**40:
            low = rng.integers(-d * size * size - 1, d * size * size + 1, (na, 3))
            high = low + rng.integers(-2, size * size, (na, 3))
            got = hard_negatives.mine(a, sliced, allowed, ids, k, (low, high), [0, 0.1, 1][trial % 3])
            assert sorted(got) == sorted((i, b, int(j), int(scores[i, j])) for i in range(na) for b in range(3) for j in first(i, [j for j in np.flatnonzero(allowed[i]) if low[i, b] <= scores[i, j] <= high[i, b]]))


def test_query_of_hard_negatives(spark):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    got = hard_negatives.op13_hard_negatives(spark, SMALL)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]


def test_hard_negatives_of_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i, rng.randint(0, 2), [rng.choice([0.0, 0.5, 1.0, -1.0, 0.25]) for _ in range(rng.choice([3, 3, 2]))]) for i in range(-20, 160)]
    rows += rows[:3] + [(50, 9, [1.0, 2.0, 3.0]), (200, 0, []), (300, 0, [70_000.0, 1.0, 0.0])]
    nan, inf = float("nan"), float("inf")
    out = [(None, 1, [1.0]), (400, None, [1.0]), (450, 1, None), (500, 1, [1.0, None]), (550, 1, [nan]), (600, 1, [inf, 0.0]), (650, 1, [-inf])]
    df = spark.createDataFrame(rows + out, "vec_id long, label int, embedding array<double>").withColumns({c: F.lit(1) for c in CLASHES})
    how = hard_negatives.Mining(rows=(16, 32), anchors=(2, 4), row_blocks=1000, anchor_blocks=1000)
    assert sorted(map(tuple, hard_negatives.hard_negatives(df, how).collect())) == plain_negatives(rows)
    assert hard_negatives.hard_negatives(df.limit(0)).collect() == []
