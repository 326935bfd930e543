"""Prefix trie of conversations: what they share from the start on, and what a prefix cache would save.

Method: the fingerprint of a prefix is a polynomial, the sum of hash(turn i) * BASE^i modulo 2^64 over its turns. A numpy
scan gives those of all prefixes; as the polynomial can be cut and put together, the fingerprints of rebuilt conversations
(head of one, rest of another) follow from the two without another scan. Prefixes of one depth and fingerprint are
candidates for one node. Each of them is verified against the group's representative (the one of least source): if their
last turns are equal, the prefixes before them have equal fingerprints and are verified by the same test one turn earlier, so one
comparison for each turn verifies all prefixes turn by turn. A group with another last turn is split: what differs from
the representative gets a representative of its own, until none differs, and a node's key is its depth, its fingerprint
and the splits on its path.

Rollup: a node's smallest member owns it, so that what a conversation owns is a chain down to its last turn. Sums over a subtree are sums
over the members' chains, and within the owner's chain a running sum from its end. No step goes level by level.

Sizes: turns are put in order by a range sort, so one conversation may hold any share of all turns: a scan's partitions are
tied by one row for each of their first and last conversations (broadcast: two rows a partition). Running sums along a chain go by
blocks of 4,096. Ids of members that end at a node are listed by blocks of 65,536 ids, and a node's digest runs over its blocks
in order, one at a time. Nothing else gathers more than a constant for a key.

Defined results: rows without conv_id take no part; null turns come first; turns of one number come in order of role, then text, and equal
rows are turns each; null role or text is empty; with no conversation there is no node, not even a root. c % family has the sign of c.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, cut, free, table

#: An odd multiplier, so it has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Depths, and ids, of a block.
CHAIN, IDS = 12, 16


@dataclass(frozen=True)
class Trie:
    #: Conversation c begins with the first crc32(c) % heads turns of conversation c - c % family. With heads=1 all stay as they are.
    family: int = 5
    heads: int = 9
    #: Low bits of a fingerprint that are used.
    bits: int = 64


# --- fingerprints ------------------------------------------------------------------------------------------------


def powers(n: int, first: int = 0) -> np.ndarray:
    """BASE^first and the n - 1 powers after it."""
    out = np.full(n, BASE, U64)
    out[:1] = pow(BASE, first, 1 << 64)
    return np.multiply.accumulate(out)


class Scan:
    """Prefix polynomials of conversations whose turns come in order, batch by batch. Places start at 1 in each."""

    def __init__(self):
        self.conv, self.at, self.sum = None, 0, U64(0)

    def add(self, convs: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.flatnonzero(np.append(True, convs[1:] != convs[:-1]))
        lengths = np.diff(np.append(starts, len(convs)))
        goes_on = convs[0] == self.conv
        places = np.arange(1, len(convs) + 1) - np.repeat(starts, lengths)
        factors = powers(int(lengths.max()) + 1)[places]
        if goes_on:
            factors[: lengths[0]] = powers(int(lengths[0]), self.at + 1)
            places[: lengths[0]] += self.at
        sums = np.cumsum(hashes * factors)
        before = np.append(U64(0), sums)[starts]
        if goes_on:
            before[:1] -= self.sum
        sums -= np.repeat(before, lengths)
        self.conv, self.at, self.sum = convs[-1], int(places[-1]), sums[-1]
        return places, sums


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    x = batch.column(name)
    return x.to_numpy(zero_copy_only=False)


def bits_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return column(batch, name).astype(np.int64).view(U64)


def scanned(turns: DataFrame) -> DataFrame:
    """part, conv_id, at, local, hash, n_bytes, role and text, in order; at and local: place and polynomial within the part."""
    ordered = turns.repartitionByRange("conv_id", "turn", "role", "text", "salt").sortWithinPartitions("conv_id", "turn", "role", "text", "salt")

    def run(batches):
        from pyspark import TaskContext

        part, scan = TaskContext.get().partitionId(), Scan()
        for batch in batches:
            if batch.num_rows:
                places, sums = scan.add(column(batch, "conv_id"), bits_of(batch, "hash"))
                own = [pa.array(np.full(batch.num_rows, part), pa.int32()), batch.column("conv_id"), pa.array(places), pa.array(sums.view(np.int64))]
                yield pa.RecordBatch.from_arrays([*own, *(batch.column(c) for c in ("hash", "n_bytes", "role", "text"))], names=["part", "conv_id", "at", "local", "hash", "n_bytes", "role", "text"])

    return ordered.select("conv_id", "hash", "n_bytes", "role", "text").mapInArrow(run, "part int, conv_id long, at long, local long, hash long, n_bytes long, role string, text string")


def carried(parts: DataFrame) -> DataFrame:
    """part, conv_id, before and carry: turns of a conversation in earlier parts, and their polynomial. For the first and last conversation of each part only, as no other one can lie in several."""
    ends = parts.groupBy("part").agg(F.array(F.min("conv_id"), F.max("conv_id")).alias("c")).select("part", F.explode(F.array_distinct("c")).alias("conv_id"))
    own = parts.join(F.broadcast(ends), ["part", "conv_id"]).groupBy("part", "conv_id").agg(F.max("at").alias("n"), F.max_by("local", "at").alias("sum"))

    def run(group: pa.Table) -> pa.Table:
        group, before, carry, out = group.sort_by("part"), 0, 0, []
        for n, total in zip(group["n"].to_pylist(), group["sum"].to_pylist(), strict=True):
            out.append((before, carry - (1 << 64) * (carry >> 63)))
            before, carry = before + n, (carry + pow(BASE, before, 1 << 64) * total) % (1 << 64)
        return pa.table({"part": group["part"], "conv_id": group["conv_id"], "before": pa.array([x for x, _ in out], pa.int64()), "carry": pa.array([x for _, x in out], pa.int64())})

    return own.groupBy("conv_id").applyInArrow(run, "part int, conv_id long, before long, carry long")


def raised(exponents: np.ndarray) -> np.ndarray:
    """BASE to each exponent, by squares: any exponents, without a table."""
    out, square, left = np.ones(len(exponents), U64), BASE, exponents.copy()
    while left.any():
        odd = (left & 1).astype(bool)
        out[odd] *= U64(square)
        square, left = square * square % (1 << 64), left >> 1
    return out


def whole(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, polynomial up to and before each turn, over all parts."""
    before, carry = column(batch, "before").astype(np.int64), bits_of(batch, "carry")
    places = column(batch, "at") + before
    sums = carry + raised(before) * bits_of(batch, "local")
    return places, sums, sums - bits_of(batch, "hash") * raised(places)


def signed(x: np.ndarray, how: Trie) -> pa.Array:
    return pa.array((x & U64((1 << how.bits) - 1)).view(np.int64))


def rebuilt(batch: pa.RecordBatch, sums: np.ndarray) -> np.ndarray:
    """Polynomials over own turns after the first h, put behind m turns of the base."""
    back = np.array([pow(INVERSE, k, 1 << 64) for k in range(256)], U64)
    return (sums - bits_of(batch, "own_sum")) * back[column(batch, "h") - column(batch, "m")] + bits_of(batch, "base_sum")


# --- nodes -------------------------------------------------------------------------------------------------------

KEY = ["depth", "fingerprint", "path"]


def verified(items: DataFrame) -> DataFrame | None:
    """depth, fingerprint, source, shared and split (1, 2, ...) of the items that differ from their group's first representative; None if none does."""
    key = ["depth", "fingerprint"]
    chosen = F.min_by(F.struct("role", "text"), F.struct("source", "shared"))
    equal = (F.col("role") == F.col("x.role")) & (F.col("text") == F.col("x.text"))

    def first(rows: DataFrame, name: str) -> DataFrame:
        return cut(rows.groupBy(*key).agg(chosen.alias("x"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), name)

    reps = first(items, "representatives")
    rest = cut(items.join(reps, key).where(~equal).select(items.columns), "differing")
    free(reps)
    splits, turn = None, 0
    while rest.limit(1).count():
        turn += 1
        reps = first(rest, f"representatives-{turn}")
        # A group of one has no further representative and is split off as it is.
        told = cut(rest.join(reps, key, "left").select(*items.columns, F.coalesce(equal, F.lit(True)).alias("same")), f"split-{turn}")
        own = told.where("same").select(*key, "source", "shared", F.lit(turn).alias("split"))
        splits = own if splits is None else splits.union(own)
        free(reps)
        rest = told.where("not same").drop("same")
    return splits


def with_paths(members: DataFrame, splits: DataFrame | None, how: Trie) -> DataFrame:
    """members with path and parent_path: the splits at their turns, none for nearly all."""
    if splits is None:
        return members.withColumn("path", F.lit("")).withColumn("parent_path", F.lit(""))
    source = F.when(F.col("shared"), F.col("conv_id") - F.col("conv_id") % how.family).otherwise(F.col("conv_id"))
    hit = members.withColumn("source", source).join(splits, ["depth", "fingerprint", "source", "shared"]).select("conv_id", F.col("depth").alias("at"), "split")
    text = lambda least: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("at") <= F.col("depth") - least, F.struct("at", "split")))), lambda s: F.concat_ws(":", s["at"].cast("string"), s["split"].cast("string"))), ",")
    paths = members.select("conv_id", "depth").join(hit, "conv_id").where("at <= depth").groupBy("conv_id", "depth").agg(text(0).alias("path"), text(1).alias("parent_path"))
    return members.join(paths, ["conv_id", "depth"], "left").fillna("", ["path", "parent_path"])


def digests(members: DataFrame) -> DataFrame:
    """SHA-256 of the ids of the members that end at each node, ascending and joined by commas."""
    listed = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    blocks = members.where("depth = total").groupBy(*KEY, F.shiftright("conv_id", IDS).alias("block")).agg(listed.alias("ids"))
    names = [*KEY, "ends_sha256"]

    def run(batches):
        now, sha = None, None
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        done = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for batch in batches:
            out = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in KEY), batch.column("ids"), strict=True):
                if key == now:
                    sha.update(b"," + ids.as_py().encode())
                else:
                    if now is not None:
                        out.append((*now, sha.hexdigest()))
                    now, sha = key, hashlib.sha256(ids.as_py().encode())
            if out:
                yield done(out)
        if now is not None:
            yield done([(*now, sha.hexdigest())])

    return blocks.repartition(*KEY).sortWithinPartitions(*KEY, "block").select(*KEY, "ids").mapInArrow(run, "depth long, fingerprint long, path string, ends_sha256 string")


def members_and_items(conversations: DataFrame, how: Trie, names: tuple[str, str, str, str]) -> tuple[DataFrame, DataFrame]:
    """Members: one row for each rebuilt conversation and depth, without texts. Items: the turns that stand for them, with texts, each once for all conversations that share it by their rebuilding."""
    conv, turn, role, text = names
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), empty(role).alias("role"), empty(text).alias("text")).where("conv_id is not null")
    turns = turns.select("*", F.xxhash64("role", "text").alias("hash"), F.octet_length("text").cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("salt"))
    parts = cut(scanned(turns), "turns")
    carries = cut(carried(parts), "carries")
    tied = lambda *cols: parts.select("part", "conv_id", "at", "local", "hash", *cols).join(F.broadcast(carries), ["part", "conv_id"], "left").fillna(0, ["before", "carry"])

    def light(batches):
        for batch in batches:
            if batch.num_rows:
                places, sums, before = whole(batch)
                yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(places), pa.array(sums.view(np.int64)), pa.array(before.view(np.int64)), batch.column("n_bytes")], names=["conv_id", "place", "sum", "sum_before", "n_bytes"])

    prefixes = cut(tied("n_bytes").mapInArrow(light, "conv_id long, place long, sum long, sum_before long, n_bytes long"), "prefixes")
    # One row for each conversation, with at most how.heads - 1 of its prefixes.
    head = F.when(F.col("place") < how.heads, F.struct("place", "sum", "sum_before", "n_bytes"))
    convs = cut(prefixes.groupBy("conv_id").agg(F.max("place").alias("length"), F.sort_array(F.collect_list(head)).alias("head")), "conversations")
    own = convs.select("conv_id", "length", F.col("head").alias("own_head"), (F.crc32(F.col("conv_id").cast("string")) % how.heads).cast("int").alias("h"), (F.col("conv_id") - F.col("conv_id") % how.family).alias("base"))
    both = own.join(convs.select(F.col("conv_id").alias("base"), F.col("length").alias("base_length"), "head"), "base", "left")
    both = both.withColumn("m", F.least("h", F.coalesce("base_length", F.lit(0))).cast("int"))
    last = lambda head, n: F.when(F.col(n) > 0, F.coalesce(F.try_element_at(F.col(head), F.col(n))["sum"], F.lit(0))).otherwise(F.lit(0).cast("long"))
    plans = cut(both.select("conv_id", "base", "h", "m", last("own_head", "h").alias("own_sum"), last("head", "m").alias("base_sum"), (F.col("m") + F.greatest(F.col("length") - F.col("h"), F.lit(0))).cast("long").alias("total"), F.slice(F.coalesce("head", F.array().cast(convs.schema["head"].dataType)), F.lit(1), F.col("m")).alias("head")), "plans")

    def later(batches):
        for batch in batches:
            if batch.num_rows:
                depth = column(batch, "place") - column(batch, "h") + column(batch, "m")
                sums, before = (signed(rebuilt(batch, bits_of(batch, c)), how) for c in ("sum", "sum_before"))
                yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(depth.astype(np.int64)), sums, before, batch.column("n_bytes"), batch.column("total"), pa.array(np.zeros(batch.num_rows, bool))], names=[f.split()[0] for f in shape.split(", ")])

    shape = "conv_id long, depth long, fingerprint long, parent long, n_bytes long, total long, shared boolean"
    rules = plans.select("conv_id", "h", "m", "own_sum", "base_sum", "total")
    rest = prefixes.join(rules, "conv_id").where("place > h").mapInArrow(later, shape)
    mask = lambda c: F.col(c).bitwiseAND((1 << how.bits) - 1 - (1 << 64) * (how.bits == 64))
    heads = plans.select("conv_id", "total", F.explode("head").alias("t")).select("conv_id", F.col("t.place").alias("depth"), mask("t.sum").alias("fingerprint"), mask("t.sum_before").alias("parent"), "t.n_bytes", "total", F.lit(True).alias("shared"))
    root = plans.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("fingerprint"), F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("n_bytes"), "total", F.lit(True).alias("shared"))
    members = cut(root.unionByName(heads).unionByName(rest), "members")

    def standing(batches):
        for batch in batches:
            if batch.num_rows:
                places, sums, _ = whole(batch)
                h, m, most = column(batch, "h"), column(batch, "m"), column(batch, "most")
                as_head, as_own = np.flatnonzero(places <= most), np.flatnonzero(places > h)
                for at, depth, prints, is_head in ((as_head, places, sums, True), (as_own, places - h + m, rebuilt(batch, sums), False)):
                    if len(at):
                        mine = batch.take(pa.array(at))
                        yield pa.RecordBatch.from_arrays([pa.array(depth[at].astype(np.int64)), signed(prints[at], how), mine.column("conv_id"), pa.array(np.full(len(at), is_head)), mine.column("role"), mine.column("text")], names=["depth", "fingerprint", "source", "shared", "role", "text"])

    used = plans.groupBy(F.col("base").alias("conv_id")).agg(F.max("m").alias("most"))
    rules = plans.join(used, "conv_id", "left").select("conv_id", "h", "m", "own_sum", "base_sum", F.coalesce("most", F.lit(0)).alias("most"))
    items = cut(tied("role", "text").join(rules, "conv_id").mapInArrow(standing, "depth long, fingerprint long, source long, shared boolean, role string, text string"), "items")
    free(prefixes, convs, plans, carries, parts)
    return members, items


def trie(conversations: DataFrame, how: Trie = Trie(), names: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text")) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    if not 1 <= how.heads <= 256:
        raise ValueError("heads must be 1 to 256")
    plain, items = members_and_items(conversations, how, names)
    splits = verified(items)
    members = plain
    if splits is None:
        members = with_paths(plain, None, how)
    else:
        members = cut(with_paths(plain, splits, how), "split-members")
    free(items)
    nodes = members.groupBy(*KEY).agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.sum((F.col("depth") == F.col("total")).cast("long")).alias("ends"), F.max("n_bytes").alias("n_bytes"), F.min("parent").alias("parent"), F.min("parent_path").alias("parent_path"))
    nodes = cut(nodes.select(*KEY, "owner", "n_convs", "parent", "parent_path", ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("own"), (F.col("ends") == F.col("n_convs")).cast("long").alias("leaf")), "nodes")
    chains = nodes.groupBy("owner").agg(F.sum("own").alias("chain"), F.max("leaf").alias("leaf"))
    below = members.join(chains.withColumnRenamed("owner", "conv_id"), "conv_id").groupBy(*KEY).agg(F.sum("chain").alias("all_chains"), F.sum("leaf").alias("n_leaves"))
    # Running sums from the end of each chain.
    block = F.shiftright("depth", CHAIN).alias("block")
    down = lambda *keys: Window.partitionBy(*keys)
    later = nodes.groupBy("owner", block).agg(F.sum("own").alias("s")).select("owner", "block", F.coalesce(F.sum("s").over(down("owner").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("later"), F.sum("s").over(down("owner")).alias("chain"))
    inside = nodes.select(*KEY, "owner", block, F.sum("own").over(down("owner", block).orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("rest"))
    tails = inside.join(later, ["owner", "block"]).select(*KEY, (F.col("rest") + F.col("later") - F.col("chain")).alias("tail"))
    up = [(F.col("depth") - 1).alias("depth"), F.col("parent").alias("fingerprint"), F.col("parent_path").alias("path")]
    children = nodes.where("depth > 0").groupBy(*up).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("fingerprint").alias("parent"), F.col("path").alias("parent_path"), F.col("owner").alias("parent_conv_id"))
    out = nodes.join(parents, ["depth", "parent", "parent_path"], "left").select(*KEY, "owner", "parent_conv_id", "n_convs")
    out = out.join(below, KEY).join(tails, KEY).join(children, KEY, "left").join(digests(members), KEY, "left")
    return out.select(F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.col("n_leaves").cast("long").alias("n_leaves"), (F.col("all_chains") + F.col("tail")).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))
