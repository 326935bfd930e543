"""Near-duplicates by MinHash with tensored banding.

Method: two collections of m small minhash bands are computed, A and B, of r hashes each. The table keys are pairs
(a_i, b_j) of bands, one from each: m bands a side give up to m*m tables of 2r hashes from 2*m*r minhashes, where plain
banding computes 2r for each table. Three diagonals of the pairs (j = i, i+1, i+2) miss hardly more than all of them,
since what is missed most is a pair that shares no band of one side; so 3*m tables are formed. Candidates that meet in a
table are confirmed on their full shingle sets (exact counts of common 64-bit shingle hashes).

Equal sets form one class first, by partial aggregation, so that copies never meet in a table. Then three levels find the
links of each table, and what is linked already isn't compared again:

1. In each table the hub is the least member. Each member is compared with the hub that it meets in most tables.
2. Members are compared with their other hubs, where the two are not in one component by then.
3. What no hub links may still be linked with each other, so tables whose members lie in several components are gone through whole. Each
   of their members has a sketch of ``sketch`` MinHashes; two members of different components are compared exactly if their sketches
   agree often enough, and a pair at the very threshold agrees less often with probability ``miss`` at most. Then nothing is left to compare.

No large table is gone through as it is: members of those with more than ``group`` members take finer tables, whose keys combine ``depth`` hashes of
their sketches (as many tables as miss a pair at the threshold with probability ``miss`` at most). A finer table that is still larger is cut into pieces, and
each two pieces meet in a cell of some ``group`` members. So no task holds more than such a group, whatever a table's size, and
only sets that agree in all of a finer table's hashes meet quadratically.

Defined results: null, empty or blank text has no shingles and is linked with nothing; a text of fewer words than a
shingle is one shingle; equal rows are linked (each row has the least doc_id of its component); rows with one doc_id are taken for one document; a row without doc_id is kept and compared with none. Any length is read whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, WordHashes, cut, free, id_text, map_rows, mix, odd, sieve, sifted, table, texts, windows


@dataclass(frozen=True)
class Tensor:
    shingle: int = 5
    #: Links have 100 * intersection >= percent * union.
    percent: int = 80
    #: Hashes of a small band; a table key has twice as many.
    rows: int = 2
    #: Share of pairs at the very threshold that may meet in no table.
    miss: float = 3e-4
    #: Pairs of bands are (a_i, b_i), (a_i, b_i+1), ...: so many for each i.
    diagonals: int = 3
    #: MinHashes of a sketch; hashes of a finer table's key; members of a table or cell that is gone through whole, about.
    sketch: int = 256
    depth: int = 10
    group: int = 256

    @property
    def bands(self) -> int:
        """Least m at which a pair at the threshold meets in no table with probability ``miss`` at most."""
        return next(m for m in range(self.diagonals, 1000) if missed((self.percent / 100) ** self.rows, m, self.diagonals) <= self.miss)

    @property
    def finer(self) -> int:
        """Finer tables, by the same rule."""
        return math.ceil(math.log(self.miss) / math.log(1 - (self.percent / 100) ** self.depth))

    @property
    def least(self) -> int:
        """Hashes in which the sketches of a pair at the threshold agree but for probability ``miss``."""
        n, q = self.sketch, self.percent / 100
        below = np.cumsum([math.comb(n, k) * q**k * (1 - q) ** (n - k) for k in range(n + 1)])
        return int(np.searchsorted(below, self.miss, side="right"))


def missed(q: float, m: int, diagonals: int) -> float:
    """Probability that no pair (a_i, b_i+k mod m), k < diagonals, is equal in both bands, each band being equal with probability q."""
    whole = 0.0
    for first in product((0, 1), repeat=diagonals - 1):
        # Whether the last bands of A are equal, from a ring that is cut before its first ones.
        states = {first: q ** sum(first) * (1 - q) ** (len(first) - sum(first))}
        for i in range(len(first), m + len(first)):
            after: dict = {}
            for last, p in states.items():
                for a in (first[i - m],) if i >= m else (0, 1):
                    x = p * (1 if i >= m else q if a else 1 - q) * (1 - q if a or any(last) else 1)
                    now = (*last[1:], a) if last else ()
                    after[now] = after.get(now, 0.0) + x
            states = after
        whole += sum(states.values())
    return whole


def shingles(text: str, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    return np.unique(windows(hashes.of(text.encode().lower().split()), size))


def least_products(values: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """For each odd factor the least of values * factor: a MinHash, as the values are well mixed already."""
    if len(values) <= 4096:
        return np.multiply.outer(factors, values).min(axis=1)
    return np.min([np.multiply.outer(factors, values[k : k + 4096]).min(axis=1) for k in range(0, len(values), 4096)], axis=0)


def small_bands(values: np.ndarray, how: Tensor, factors: np.ndarray) -> np.ndarray:
    """The 2m hashes of the small bands (first A, then B)."""
    least = least_products(values, factors).reshape(-1, how.rows)
    out = least[:, 0]
    for k in range(1, how.rows):
        out = mix(out * U64(0x9E3779B97F4A7C15) + least[:, k])
    return mix(out + np.arange(1, len(out) + 1, dtype=U64))


def profiles(docs: DataFrame, how: Tensor, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set and the small bands, for each row."""

    def make():
        import xxhash

        hashes, factors = WordHashes(), odd(2 * how.bands * how.rows, 11)

        def each(batch):
            out = {"doc_id": batch.column("doc_id"), "n_shingles": [], "set_hi": [], "set_lo": [], "bands": []}
            for t in texts(batch):
                s = shingles(t, how.shingle, hashes)
                digest = xxhash.xxh3_128_intdigest(s.tobytes()) if len(s) else 0
                out["n_shingles"].append(len(s))
                out["set_hi"].append((digest >> 64) - (1 << 63))
                out["set_lo"].append((digest & ((1 << 64) - 1)) - (1 << 63))
                out["bands"].append(small_bands(s, how, factors).view(np.int64) if len(s) else None)
            return out

        return each

    return map_rows(id_text(docs, id_col, text_col), make, "doc_id long, n_shingles long, set_hi long, set_lo long, bands array<long>")


def table_keys(reps: DataFrame, how: Tensor) -> DataFrame:
    """(key, id) for all tables: pairs of a band of A with one of B."""
    m = how.bands
    pairs = [F.xxhash64(F.col("bands")[i], F.col("bands")[m + (i + k) % m]) for i in range(m) for k in range(how.diagonals)]
    return reps.select(F.explode(F.array(*pairs)).alias("key"), F.col("rep").alias("id"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with common and total counts from both full sets. The hub side b may be a hot key: its join can be split by AQE, as both sides are plain exchanges. Only sets of each side's own ids are shuffled."""
    of = lambda end: sifted(sets, "id", sieve(pairs.select(end))).select(F.col("id").alias(end), F.col("values").alias(f"v{end}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "va", "vb")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            common, total = [], []
            for x, y in zip(batch.column("va"), batch.column("vb"), strict=True):
                p, q = np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64)
                n = len(np.intersect1d(p, q, assume_unique=True))
                common.append(n)
                total.append(len(p) + len(q) - n)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), pa.array(total, pa.int64())], names=["a", "b", "common", "total"])

    return both.mapInArrow(run, "a long, b long, common long, total long")


def sketched(sets: DataFrame, how: Tensor) -> DataFrame:
    """id, sketch (8 bits of each MinHash: different ones agree by chance once in 256, which only adds pairs to compare) and the keys of its finer tables."""

    def make():
        factors, rng = odd(how.sketch, 31), np.random.default_rng(32)
        chosen = np.array([rng.choice(how.sketch, min(how.depth, how.sketch), replace=False) for _ in range(how.finer)])
        weights = odd(chosen.shape[1], 33)

        def each(batch):
            out = {"id": batch.column("id"), "sketch": [], "keys": []}
            for x in batch.column("values"):
                least = mix(least_products(np.frombuffer(x.as_py(), U64), factors))
                out["sketch"].append(least.astype(np.uint8).tobytes())
                out["keys"].append(mix(mix((least[chosen] * weights).sum(axis=1)) + np.arange(len(chosen), dtype=U64)).view(np.int64))
            return out

        return each

    return map_rows(sets, make, "id long, sketch binary, keys array<long>")


def mixed_tables(placed: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """key and members of the tables (key, id) whose members lie in several components."""
    by_key = placed.join(labels, "id").groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    return cut(by_key.where("lo <> hi").select("key", "members"), name)


def likely(seats: DataFrame, labels: DataFrame, sketches: DataFrame, how: Tensor) -> DataFrame:
    """Pairs (a, b), a > b, of members that share a table but no component, and whose sketches agree often enough.

    Of all tables that two members share, only the one of least short name gives the pair, and of a table's cells only one, so each pair is a row once.
    Names have 32 bits: that two members share one without its table, and so lose their pair, is a chance of one in a million."""
    own = seats.groupBy("id").agg(F.sort_array(F.collect_set(F.hash("table"))).alias("all"))
    members = sketches.select("id", "sketch").join(own, "id").join(labels, "id")
    columns = ["key", "table", "piece", "whole", "id", "label", "sketch", "all"]
    rows = seats.withColumn("table", F.hash("table")).join(members, "id").select(columns).repartition("key").sortWithinPartitions("key")
    least = how.least

    def pairs(group: pa.Table):
        ids, own, piece = (group[c].to_numpy() for c in ("id", "label", "piece"))
        sketch = np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint8).reshape(len(ids), -1)
        # Members of one piece meet in the cell that is theirs alone.
        apart = None if group["whole"][0].as_py() else piece
        table_, shared = group["table"][0].as_py(), [set(x) for x in group["all"].to_pylist()]
        for at in range(0, len(ids), 32):
            agree = (sketch[at : at + 32, None] == sketch[None]).sum(axis=2, dtype=np.int32)
            agree[(own[at : at + 32, None] == own[None]) | (agree < least)] = 0
            if apart is not None:
                agree[apart[at : at + 32, None] == apart[None]] = 0
            for i, j in zip(*(x.tolist() for x in np.nonzero(agree)), strict=True):
                if ids[at + i] > ids[j] and min(shared[at + i] & shared[j]) == table_:
                    yield max(ids[at + i], ids[j]), min(ids[at + i], ids[j])

    def through(rows_: pa.Table):
        """Pairs of whole groups of one key."""
        keys = rows_["key"].to_numpy()
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            found = sorted(set(pairs(rows_.slice(x, y - x))))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches):
        held = None  # rows of the last key so far, which may go on
        for batch in batches:
            if batch.num_rows:
                held = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
                keys = held["key"].to_numpy()
                if keys[0] != keys[-1]:
                    last = len(keys) - int(np.argmax(keys[::-1] != keys[-1]))
                    yield from through(held.slice(0, last))
                    held = held.slice(last)
        if held is not None:
            yield from through(held)

    return rows.mapInArrow(run, "a long, b long").distinct()


def seated(tables: DataFrame, sketches: DataFrame, labels: DataFrame, how: Tensor) -> DataFrame:
    """(key, table, piece, whole, id): groups of at most some ``group`` members, in which every pair that shares one of the mixed tables (key, id, members) and isn't missed there meets. key: a table, or a cell of two of its pieces; whole: its members all meet."""
    alone = [F.col("key"), F.col("key").alias("table"), F.lit(0).cast("long").alias("piece"), F.lit(True).alias("whole"), F.col("id")]
    small = tables.where(F.col("members") <= how.group).select(alone)
    # Members of large tables, by their finer ones.
    finer = tables.where(F.col("members") > how.group).select("id").distinct().join(sketches, "id").select("id", F.explode("keys").alias("key"))
    mixed = mixed_tables(finer, labels, "finer-tables")
    placed = finer.join(mixed, "key")
    pieces = F.ceil(F.col("members") * 2 / how.group)
    piece = F.pmod(F.xxhash64("id"), pieces)
    met = placed.where(F.col("members") > how.group).select("id", "key", piece.alias("piece"), F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)).alias("other"))
    cells = met.select(F.xxhash64("key", F.least("piece", "other"), F.greatest("piece", "other")).alias("key"), F.col("key").alias("table"), "piece", (F.col("piece") == F.col("other")).alias("whole"), "id")
    return small.union(placed.where(F.col("members") <= how.group).select(alone)).union(cells)


def full_sets(docs: DataFrame, wanted: DataFrame, how: Tensor, id_col: str, text_col: str) -> DataFrame:
    """id and the sorted shingle hashes of the wanted documents, and of a few others that their sieve lets pass. No text is shuffled."""
    mine = sifted(id_text(docs, id_col, text_col), "doc_id", sieve(wanted.select("id")))

    def make():
        hashes = WordHashes()

        def each(batch):
            return {"id": batch.column("doc_id"), "values": [shingles(t, how.shingle, hashes).tobytes() for t in texts(batch)]}

        return each

    return map_rows(mine, make, "id long, values binary")


def components(edges: DataFrame, name: str = "labels") -> DataFrame:
    """(id, label) of the nodes of edges (a, b), label being the least id reachable. Labels spread to neighbours and jump to their own label until none changes; each round is a written table, so that nothing but a count comes to the driver."""
    both = cut(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), f"{name}-edges")
    before = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near")).select("id", F.least("id", "near").alias("label")), f"{name}-0")
    labels, turn = before, 0
    while True:
        turn += 1
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "id")
        step = cut(labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label")), f"{name}-{turn}a")
        jump = step.select(F.col("id").alias("label"), F.col("label").alias("further"))
        after = cut(step.join(jump, "label", "left").select("id", "old", F.least("label", F.coalesce("further", "label")).alias("label")), f"{name}-{turn}b")
        changed = after.where("old <> label").limit(1).count()
        free(step, before)
        before, labels = after, after.select("id", "label")
        if not changed:
            free(both)
            labels.written_at = after.written_at
            return labels


def ends(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """pairs (a, b) with the labels x and y of their ends."""
    return pairs.join(labels.select(F.col("id").alias("a"), F.col("label").alias("x")), "a").join(labels.select(F.col("id").alias("b"), F.col("label").alias("y")), "b")


def merged(labels: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """labels after further links: components of components. The least id of a component stays its label."""
    roots = components(ends(links, labels).where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")), name)
    out = cut(labels.join(roots.select(F.col("id").alias("label"), F.col("label").alias("root")), "label", "left").select("id", F.coalesce("root", "label").alias("label")), name)
    free(roots, labels)
    return out


def near_duplicates(docs: DataFrame, how: Tensor = Tensor(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row for each row of docs."""
    own = cut(profiles(docs, how, id_col, text_col), "profiles")
    full = own.where("n_shingles > 0 and doc_id is not null")
    # Classes of equal sets; map-side minima, so a class of a third of all rows costs one row from each task.
    reps = cut(full.groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands")), "classes")
    keys = table_keys(reps, how)
    hubs = cut(keys.groupBy("key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("members")).where("members > 1").select("key", "hub"), "hubs")
    # A member and its hubs, with the number of tables in which they meet.
    stars = cut(keys.join(hubs, "key").where("id <> hub").groupBy(F.col("id").alias("a"), F.col("hub").alias("b")).agg(F.count(F.lit(1)).alias("tables")), "stars")
    free(hubs)
    wanted = stars.select(F.col("a").alias("id")).union(stars.select("b")).distinct()
    labels = cut(wanted.select("id", F.col("id").alias("label")), "labels")
    sets = cut(full_sets(docs, labels, how, id_col, text_col), "sets")
    linked = F.col("common") * 100 >= F.col("total") * how.percent

    def add(labels: DataFrame, pairs: DataFrame, name: str) -> tuple[DataFrame, bool]:
        """Labels after the links among pairs, and whether there are any."""
        found = cut(verified(pairs, sets).where(linked).select("a", "b"), f"{name}-links")
        more = bool(found.limit(1).count())
        if more:
            labels = merged(labels, found, name)
        free(found)
        return labels, more

    # Levels 1 and 2.
    main = cut(stars.groupBy("a").agg(F.max_by("b", F.struct("tables", -F.col("b"))).alias("b")), "main-hubs")
    labels, _ = add(labels, main, "level-1")
    rest = cut(ends(stars.join(main, ["a", "b"], "left_anti"), labels).where("x <> y").select("a", "b"), "other-hubs")
    labels, _ = add(labels, rest, "level-2")
    free(main, rest)
    # Level 3. Only members and hubs of stars share a table with others.
    members = stars.select(F.col("a").alias("id")).union(stars.select("b")).distinct()
    placed = cut(keys.join(members, "id", "left_semi"), "placed")
    mixed = mixed_tables(placed, labels, "mixed-tables")
    tables = cut(placed.join(mixed, "key"), "tables")
    sketches = cut(sketched(sifted(sets, "id", sieve(tables.select("id"))), how), "sketches")
    seats = cut(seated(tables, sketches, labels, how), "seats")
    free(placed, mixed, tables)
    pairs = cut(likely(seats, labels, sketches, how).join(stars.select("a", "b"), ["a", "b"], "left_anti"), "likely")
    free(seats, sketches, stars)
    labels, _ = add(labels, pairs, "level-3")
    free(pairs, sets)
    # Component of a class, then of its rows. Every row of a hot class gets its label by a join on the set's digest, which AQE can split.
    final = cut(reps.select("set_hi", "set_lo", F.col("rep").alias("id")).join(labels, "id", "left").select("set_hi", "set_lo", F.coalesce("label", "id").alias("component")), "final")
    free(reps, labels)
    out = own.select("doc_id", "n_shingles", "set_hi", "set_lo").join(final, ["set_hi", "set_lo"], "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    out.holds = (own, final)
    return out


def drop_duplicates(docs: DataFrame, how: Tensor = Tensor(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component, the one of least doc_id, in docs' own columns. Rows that repeat a doc_id are one document, of which one row stays; rows without doc_id all stay.

    Texts are not shuffled to learn which stay: rows that the sieve of duplicates surely doesn't hold stay. Of the others a second sieve takes those that may
    stay nevertheless, and only these few are joined with the ids."""
    all_rows = near_duplicates(docs, how, id_col, text_col)
    found = cut(all_rows, "near-duplicates")
    free(*all_rows.holds)
    kept = found.where("kept and doc_id is not null").select("doc_id")
    repeated = cut(kept.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    doubtful = sieve(found.where("not kept").select("doc_id").union(repeated))
    # Ids that stay though that sieve holds them: the repeated ones, and some by chance.
    held = cut(sifted(kept, "doc_id", doubtful).distinct(), "held")
    own = F.col(id_col).cast("long")
    among = lambda rows, ids, kind: rows.join(ids.select(F.col("doc_id").alias("sieve_id")), own == F.col("sieve_id"), kind)
    rest = among(sifted(sifted(docs, id_col, doubtful), id_col, sieve(held)), held, "left_semi")
    if repeated.limit(1).count():
        rest = among(rest, repeated, "left_anti").unionByName(among(rest, repeated, "left_semi").dropDuplicates([id_col]))
    return sifted(docs, id_col, doubtful, held=False).unionByName(rest).select(docs.columns)


def op7_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Tensor(percent=85))
