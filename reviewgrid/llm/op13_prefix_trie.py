"""Operator 13: prefix trie of conversations, with double-array tries per prefix shard.

Every conversation is rebuilt (the first ``h`` turns of conversation ``c - c % 100``, then its
own turns after its first ``h``), and each distinct sequence of first turns is a node. A
node is named by its depth and exact sums of position-tagged 32-bit hashes of its turns (128
bits in all), so all prefixes of a conversation follow from running sums, which are taken
over blocks of ``BLOCK`` turns and offset by the blocks before.

A node with one member is the start of a tail: its row follows from the conversation alone.
The nodes with more members form the tries. Each is cut at the nodes that stand over more than
``shard_turns`` turns: below them, a shard packs BASE and CHECK arrays over dense ids of its
turns and traverses them for children, leaves and tokens saved; the few upper nodes, which many
shards share, are merged by sums of what their shards and children report.

Scale. A hot prefix is split by its next turn, a hot group of copies is one path, a hot
conversation is numbered and summed in ranges and blocks, and members' ids are joined in
blocks of 65,536 consecutive ids, then hashed as a stream. A task holds the shared part of a
conversation (hashes, not texts), and the work at upper nodes grows with their depth.

Defined cases: a null role or text is empty; null turns come first; rows of one turn follow
role, the first 64 characters of the text, then a hash; repeated rows are turns of their own; rows without
conv_id are left out; a conversation that ends up without turns is a member of the root
only; an absent or short base gives fewer turns; very long texts are hashed whole; further columns, whatever
their names, are ignored; an empty table gives no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import position_within
from .common import ship_package, spill

BLOCK = 4096
SHARD_TURNS = 200_000
SUMS = ["s1", "s2", "s3", "s4"]
KEY = ["k1", "k2"]
EMPTY = hashlib.sha256(b"").hexdigest()
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _key(depth: Column, sums: list[Column]) -> list[Column]:
    """The 128-bit name of a node."""
    return [F.xxhash64(depth, sums[0], sums[1]), F.xxhash64(sums[2], sums[3], depth)]


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, d, a1, a2, chars) per rebuilt turn, and (conv_id, size) per conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.substring(text, 1, 64).alias("head"),
        F.xxhash64(role, text).alias("a1"), F.xxhash64(F.lit(1), text, role).alias("a2"), F.length(text).cast("long").alias("chars"))
    placed = spill(position_within(turns, ["conv_id"], [F.asc_nulls_first("turn"), F.col("role"), F.col("head"), F.col("a1"), F.col("a2")], "pos")
                   .select("conv_id", "pos", "a1", "a2", "chars"), "turns")
    h = (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int")
    first = placed.filter((F.col("pos") <= 5) & (F.col("conv_id") % 100 == 0)).groupBy(F.col("conv_id").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "a1", "a2", "chars"))).alias("first"))
    about = placed.groupBy("conv_id").agg(F.max("pos").alias("n")).withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % 100)
    about = spill(about.join(first, "base", "left").withColumn("taken", F.coalesce(F.slice("first", 1, F.col("h")), F.array().cast("array<struct<pos:int,a1:bigint,a2:bigint,chars:bigint>>")))
                  .select("conv_id", "h", "taken", (F.size("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("size")), "conversations")
    heads = about.select("conv_id", F.explode("taken").alias("t")).select("conv_id", F.col("t.pos").alias("d"), "t.a1", "t.a2", "t.chars")
    moved = about.filter(F.size("taken") < F.col("h")).select("conv_id", (F.col("h") - F.size("taken")).alias("shift"))
    own = placed.filter(F.col("pos") > h).join(moved, "conv_id", "left").select(
        "conv_id", (F.col("pos") - F.coalesce("shift", F.lit(0))).alias("d"), "a1", "a2", "chars")
    return heads.union(own), about.select("conv_id", "size")


def prefixes(turns: DataFrame, sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conversation and depth: its node, the node's parent, the turn and what follows."""
    low, high = F.lit(0xFFFFFFFF), 32
    one, two = F.xxhash64("d", "a1", "a2"), F.xxhash64("a2", "d", "a1")
    tagged = turns.withColumn("block", F.floor((F.col("d") - 1) / block).cast("int")).select(
        "*", one.bitwiseAND(low).alias("x1"), F.shiftrightunsigned(one, high).alias("x2"),
        two.bitwiseAND(low).alias("x3"), F.shiftrightunsigned(two, high).alias("x4"))
    run = Window.partitionBy("conv_id", "block").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    local = spill(tagged.select("conv_id", "block", "d", "a1", "a2", "chars", "x1", "x2", "x3", "x4",
                                *[F.sum(f"x{i}").over(run).alias(f"s{i}") for i in (1, 2, 3, 4)]), "running")
    totals = local.groupBy("conv_id", "block").agg(*[F.max(s).alias(s) for s in SUMS])  # running sums never fall
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("conv_id", "block", *[F.sum(s).over(earlier).alias("o" + s) for s in SUMS]).filter("block > 0")
    later = local.filter("block > 0").join(offsets, ["conv_id", "block"])
    rows = local.filter("block = 0").withColumns({"o" + s: F.lit(0).cast("long") for s in SUMS}).unionByName(later)
    after = [F.col(s) + F.col("o" + s) for s in SUMS]
    before = [a - F.col(f"x{i + 1}") for i, a in enumerate(after)]
    own, parent = _key(F.col("d"), after), _key(F.col("d") - 1, before)
    return rows.join(sizes, "conv_id").select(
        "conv_id", "d", "a1", "a2", "chars", own[0].alias("k1"), own[1].alias("k2"), parent[0].alias("p1"), parent[1].alias("p2"),
        (F.col("size") - F.col("d")).alias("rest"))


class DoubleArray:
    """BASE and CHECK arrays over sorted sequences of dense ids (from 0). State 0 is the root;
    the child of state s by id c is ``base[s] + c`` if its ``check`` is s."""

    def __init__(self, sequences: list[list[int]], ids: int):
        self.base, self.check, self.order = [0], [0], []
        self._free = 1
        todo = [(0, 0, len(sequences), 0)]
        for state, lo, hi, depth in todo:  # breadth first; grows while it is walked
            while lo < hi and len(sequences[lo]) == depth:
                lo += 1
            starts = [i for i in range(lo, hi) if i == lo or sequences[i][depth] != sequences[i - 1][depth]]
            self.order.append(state)
            if not starts:
                continue
            labels = [sequences[i][depth] for i in starts]
            b = self.base[state] = self._fit(labels, ids)
            for c in labels:
                self.check[b + c] = state
            for k, i in enumerate(starts):
                todo.append((b + labels[k], i, starts[k + 1] if k + 1 < len(starts) else hi, depth + 1))

    def _room(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.check += [-1] * more
            self.base += [0] * more

    def _fit(self, labels: list[int], ids: int) -> int:
        """The first place where all labels fall on free cells."""
        while self._free < len(self.check) and self.check[self._free] >= 0:
            self._free += 1
        at = max(self._free, labels[0] + 1)
        while True:
            b = at - labels[0]
            self._room(b + ids + 1)
            if all(self.check[b + c] < 0 for c in labels):
                return b
            at += 1
            while at < len(self.check) and self.check[at] >= 0:
                at += 1

    def child(self, state: int, c: int) -> int:
        at = self.base[state] + c
        return at if 0 < at < len(self.check) and self.check[at] == state and at != state else -1


LIGHT = "k1 long, k2 long, n_children long, n_leaves long, saved long, tops long, top_convs long, summary boolean"


def shard_nodes(table: pa.Table) -> pa.Table:
    """The nodes of one shard, and a summary row for the upper node above it.

    ``table`` has the sequences of the shard: ``path``, a list of (d, k1, k2, a1, a2, n, ends, chars).
    """
    up = (table["u1"][0].as_py(), table["u2"][0].as_py())
    paths = table["path"].to_pylist()
    ids: dict[tuple[int, int], int] = {}
    for p in paths:
        for x in p:
            ids.setdefault((x["a1"], x["a2"]), len(ids))
    coded = sorted(([ids[x["a1"], x["a2"]] for x in p], i) for i, p in enumerate(paths))
    trie = DoubleArray([s for s, _ in coded], len(ids))
    at = {}
    for s, i in coded:  # walk every sequence; a state's values are those of its node
        state = 0
        for c, x in zip(s, paths[i], strict=True):
            state = trie.child(state, c)
            at[state] = x
    size = len(trie.check)
    shared, convs, leaves, saved = ([0] * size for _ in range(4))
    out = []
    for state in reversed(trie.order):  # children come before their parents
        if not state:
            break
        x, up_state = at[state], trie.check[state]
        alone = x["n"] - x["ends"] - convs[state]
        children = shared[state] + alone
        leaves[state] += alone if children else 1
        saved[state] += (x["n"] - 1) * x["chars"]
        out.append((x["k1"], x["k2"], children, leaves[state], saved[state], 0, 0, False))
        for total, value in ((shared, 1), (convs, x["n"]), (leaves, leaves[state]), (saved, saved[state])):
            total[up_state] += value
    out.append((*up, 0, leaves[0], saved[0], shared[0], convs[0], True))
    names = [f.split(" ")[0] for f in LIGHT.split(", ")]
    return pa.table([pa.array(c, pa.bool_() if k == 7 else pa.int64()) for k, c in enumerate(zip(*out, strict=True))], names=names)


def digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, sha) of the ascending, comma-joined conv_ids of each node. Ids meet in blocks of 65,536
    consecutive ones; the blocks of a node are hashed as a stream."""
    ship_package(ends.sparkSession)
    blocks = ends.groupBy(*KEY, F.shiftright("conv_id", 16).alias("block")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, out = None, None, []
        for batch in batches:
            for k1, k2, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (k1, k2) != key:
                    if key:
                        out.append((*key, sha.hexdigest()))
                    key, sha = (k1, k2), hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
        if key:
            out.append((*key, sha.hexdigest()))
        cols = list(zip(*out, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=[*KEY, "sha"])

    return blocks.repartition(*KEY).sortWithinPartitions(*KEY, "block").mapInArrow(run, "k1 long, k2 long, sha string")


def nodes(conversations: DataFrame, shard_turns: int = SHARD_TURNS, block: int = BLOCK) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (columns ``RESULT``)."""
    ship_package(conversations.sparkSession)
    turns, sizes = rebuilt(conversations)
    rows = spill(prefixes(turns, sizes, block), "prefixes")
    root_key = _key(F.lit(0), [F.lit(0).cast("long")] * 4)
    root = sizes.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), F.sum((F.col("size") == 0).cast("long")).alias("ends"),
                     F.min(F.when(F.col("size") == 0, F.col("conv_id"))).alias("end_conv"), F.sum("size").alias("weight")).filter("n > 0").select(
        root_key[0].alias("k1"), root_key[1].alias("k2"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"),
        F.lit(0).alias("depth"), F.lit(0).cast("long").alias("chars"), "conv_id", "n", "ends", "end_conv", "weight")
    last = F.col("rest") == 0
    tree = spill(rows.groupBy(*KEY).agg(
        F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("d").alias("depth"), F.first("chars").alias("chars"),
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), F.sum(last.cast("long")).alias("ends"),
        F.min(F.when(last, F.col("conv_id"))).alias("end_conv"), F.sum(F.col("rest") + 1).alias("weight")).unionByName(root), "nodes")
    shared = tree.filter((F.col("n") > 1) | (F.col("depth") == 0))
    inner = shared.filter("depth > 0")

    # the paths of the shared nodes: of each shared node without a shared child, its smallest member's
    bottom = inner.join(inner.select(F.col("p1").alias("k1"), F.col("p2").alias("k2")).distinct(), KEY, "left_anti")
    path = rows.join(bottom.select("conv_id", F.col("depth").alias("to")), "conv_id").filter("d <= to").select("conv_id", "d", "a1", "a2", *KEY)
    step = F.struct("d", *KEY, "a1", "a2", "n", "ends", "chars", "weight")
    paths = path.join(inner.select(*KEY, "n", "ends", "chars", "weight"), KEY).groupBy("conv_id").agg(F.sort_array(F.collect_list(step)).alias("path"))
    total = root.select("weight").first()
    spread = (total["weight"] or 0) // shard_turns + 1 if total else 1
    heavy = F.filter("path", lambda x: x["weight"] > shard_turns)
    top = F.get("path", F.size("upper"))
    over = F.element_at("upper", -1)
    cut = spill(paths.withColumn("upper", heavy).select(
        "upper", F.slice("path", F.size("upper") + 1, F.size("path")).alias("path"),
        F.when(F.size("upper") > 0, over["k1"]).otherwise(root_key[0]).alias("u1"), F.when(F.size("upper") > 0, over["k2"]).otherwise(root_key[1]).alias("u2"),
        F.pmod(top["k1"], F.when(F.size("upper") > 0, F.ceil(over["weight"] / shard_turns)).otherwise(F.lit(spread))).alias("bucket")), "paths")
    light = spill(cut.filter(F.size("path") > 0).select("u1", "u2", "bucket", "path").groupBy("u1", "u2", "bucket").applyInArrow(shard_nodes, LIGHT), "shards")

    # upper nodes: their direct children, then sums over themselves and every upper node below
    upper = shared.filter((F.col("weight") > shard_turns) | (F.col("depth") == 0))
    direct = light.filter("summary").select(*KEY, "tops", "top_convs", "n_leaves", "saved").union(
        upper.filter("depth > 0").select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.lit(1).cast("long"), "n", F.lit(0).cast("long"), F.lit(0).cast("long")))
    direct = direct.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in ("tops", "top_convs", "n_leaves", "saved")])
    zero = {c: 0 for c in ("tops", "top_convs", "n_leaves", "saved")}
    own = upper.join(direct, KEY, "left").na.fill(zero).withColumn("alone", F.col("n") - F.col("ends") - F.col("top_convs"))
    own = own.select(*KEY, (F.col("tops") + F.col("alone")).alias("n_children"),
                     (F.col("n_leaves") + F.when(F.col("tops") + F.col("alone") == 0, 1).otherwise(F.col("alone"))).alias("n_leaves"),
                     (F.col("saved") + (F.col("n") - 1) * F.col("chars")).alias("saved"))
    chain = cut.select(F.explode(F.transform("upper", lambda x, i: F.struct(
        x["k1"].alias("k1"), x["k2"].alias("k2"), F.slice("upper", F.lit(1), i).alias("above")))).alias("u")).select("u.*").dropDuplicates(KEY)
    up = own.join(chain, KEY, "left").select("n_leaves", "saved", F.explode(F.concat(
        F.coalesce(F.transform("above", lambda x: F.struct(x["k1"].alias("k1"), x["k2"].alias("k2"))), F.array().cast("array<struct<k1:bigint,k2:bigint>>")),
        F.array_distinct(F.array(F.struct(*KEY), F.struct(root_key[0].alias("k1"), root_key[1].alias("k2")))))).alias("a"))
    sums = up.groupBy(F.col("a.k1").alias("k1"), F.col("a.k2").alias("k2")).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    found = light.filter("not summary").select(*KEY, "n_children", "n_leaves", "saved").union(
        own.select(*KEY, "n_children").join(sums, KEY).select(*KEY, "n_children", "n_leaves", "saved"))

    # members that end at a node: none, one (known), or a list to hash
    many = shared.filter("ends > 1").select(*KEY)
    ending = rows.filter(last).select(*KEY, "conv_id").union(sizes.filter("size = 0").select(root_key[0], root_key[1], "conv_id"))
    lists = digests(ending.join(many, KEY, "left_semi"))
    full = shared.join(found, KEY).join(lists, KEY, "left").select(
        *KEY, "p1", "p2", "conv_id", "depth", "n", "n_children", "n_leaves", "saved", "sha", "end_conv")
    alone = tree.filter((F.col("n") == 1) & (F.col("depth") > 0)).select(
        *KEY, "p1", "p2", "conv_id", "depth", "n", (1 - F.col("ends")).alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved"), F.lit(None).cast("string").alias("sha"), "end_conv")
    above = shared.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("above"))
    # a parent that is not shared has this node's one member
    return full.union(alone).join(above, ["p1", "p2"], "left").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), F.when(F.col("depth") > 0, F.coalesce("above", "conv_id")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("sha", F.sha2(F.col("end_conv").cast("string"), 256), F.lit(EMPTY)).alias("ends_sha256"))

