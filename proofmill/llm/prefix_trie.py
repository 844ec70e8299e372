"""Prefix trie of conversations by partition refinement.

Every conversation is in one class at first. Turn by turn a class is split by its members' next turns, so the classes at depth d are the
trie's nodes of depth d. A class of one member is retired: the rest of its turns is a chain of nodes with one child each, written out without being
looked at again. A round splits a run of turns, each run twice as long as the one before, so the number of rounds is the logarithm of the
longest shared prefix, and conversations that are still active pass each round once. What a subtree sums up is folded back afterwards:
each conversation stands for the nodes whose smallest member it is, a deepest part of its path, and a node's sum is that of its members' parts below it.

A node's identity is the SHA-256 of its parent's identity and its last turn's SHA-256, so a member finds its class without asking the others; only
counts, least members and sums are shuffled, combined before. Positions of turns come from a range sort over all
rows (a conversation may lie in many tasks) and the tasks' own counts. Ids of the conversations that end at a node are sorted and joined in chunks, and
only the chunks of one node go through one task, a stream into one hash. Parents of very many nodes are joined by broadcast of their bounded number.

Defined results: rows with a null conv_id belong to no conversation and are left out. A null role or text is empty. Turns that repeat a number
are ordered by the hash of their role and text; repeated rows are turns of their own. The family of c begins at c - c % family, where % has the
sign of c. Texts of any length are read whole. An empty table has no node. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyspark
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, is_empty, join_unique, with_hot

#: Ids that one chunk joins.
CHUNK = 1 << 16
ROOT = b""
NOTHING = hashlib.sha256(b"").hexdigest()


def positions(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (c, turn, key, words) as (c, pos, key, words): pos counts from 1 in the order of turn, null first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Position among the rows of c in this task."""
        task, now, at = pyspark.TaskContext.get().partitionId(), None, 0
        for b in batches:
            own = []
            for c in b.column(0).to_pylist():
                now, at = c, at + 1 if c == now else 1
                own.append(at)
            yield pa.record_batch([b.column(0), pa.array([task] * len(own), pa.int64()), pa.array(own, pa.int64()), b.column(2), b.column(3)], ["c", "task", "own", "key", "words"])

    dealt = rows.repartitionByRange("c", F.col("turn").asc_nulls_first(), "key").sortWithinPartitions("c", F.col("turn").asc_nulls_first(), "key")
    local = scratch.write(dealt.mapInArrow(count, "c long, task long, own long, key binary, words long"), "positions")
    # One row for each task; conversations that lie in several of them are the last of one and the first of another.
    ends = sorted(local.groupBy("task").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).collect())
    cut = {x.hi for x, y in zip(ends, ends[1:], strict=False) if x.hi == y.lo}
    if not cut:
        return local.select("c", F.col("own").alias("pos"), "key", "words")
    sizes = local.where(F.col("c").isin(*cut)).groupBy("c", "task").agg(F.max("own").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("c").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return local.join(F.broadcast(sizes.select("c", "task", before.alias("before"))), ["c", "task"], "left").select("c", (F.col("own") + F.coalesce("before", F.lit(0))).alias("pos"), "key", "words")


def rebuild(turns: DataFrame, scratch: Scratch, family: int, modulus: int) -> tuple[DataFrame, DataFrame]:
    """Conversations (c, len) and their rebuilt turns (c, pos, key, words): the first crc32(c) % modulus turns come from the family's first conversation."""
    convs = scratch.write(turns.groupBy("c").agg(F.count("*").alias("n")), "sizes")
    head = F.crc32(F.col("c").cast("string").cast("binary")) % modulus
    base = convs.select(F.col("c").alias("base"), F.col("n").alias("base_n"))
    plan = convs.select("c", "n", head.alias("h"), (F.col("c") - F.col("c") % family).alias("base")).join(base, "base", "left").withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0))))
    plan = scratch.write(plan.select("c", "n", "h", "base", "m"), "plan")
    own = join_unique(turns, with_hot(plan.select("c", "h", "m", "n"), "n").drop("n"), "c", "inner").where("pos > h").select("c", (F.col("m") + F.col("pos") - F.col("h")).alias("pos"), "key", "words")
    first = turns.where(F.col("pos") < modulus).withColumnRenamed("c", "base")
    taken = plan.where("m > 0").select("c", "base", "m").join(first, "base").where("pos <= m").select("c", "pos", "key", "words")
    convs = scratch.write(plan.select("c", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "convs")
    return convs, scratch.write(own.unionByName(taken), "rebuilt")


def split(rows: DataFrame) -> DataFrame:
    """Rows (c, pos, key, words, class), class that of c before this run of turns, as (c, pos, node, parent, words)."""

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, node = None, b""
        for b in batches:
            nodes, parents = [], []
            for c, key, own in zip(*(b.column(i).to_pylist() for i in (0, 2, 4)), strict=True):
                if c != now:
                    now, node = c, own
                parents.append(node)
                node = hashlib.sha256(node + key).digest()
                nodes.append(node)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(nodes, pa.binary()), pa.array(parents, pa.binary()), b.column(3)], ["c", "pos", "node", "parent", "words"])

    return rows.repartition("c").sortWithinPartitions("c", "pos").select("c", "pos", "key", "words", "class").mapInArrow(chain, "c long, pos long, node binary, parent binary, words long")


def hash_lists(rows: DataFrame) -> DataFrame:
    """Rows (node, c) as (node, sha): SHA-256 of each node's decimal ids, ascending and joined by commas."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def made() -> pa.RecordBatch:
            return pa.record_batch([pa.array([now], pa.binary()), pa.array([held[0]], pa.int64()), pa.array([",".join(map(str, held))])], ["node", "first", "ids"])

        for b in batches:
            for node, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held and (node != now or len(held) == CHUNK):
                    yield made()
                    held = []
                now = node
                held.append(c)
        if held:
            yield made()

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = None, None
        for b in batches:
            done = []
            for node, ids in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                if node != now:
                    if h:
                        done.append((now, h.hexdigest()))
                    now, h = node, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(ids.as_py().encode())
            yield pa.record_batch([pa.array([x for x, _ in done], pa.binary()), pa.array([x for _, x in done], pa.string())], ["node", "sha"])
        if h:
            yield pa.record_batch([pa.array([now], pa.binary()), pa.array([h.hexdigest()])], ["node", "sha"])

    joined = rows.select("node", "c").repartitionByRange("node", "c").sortWithinPartitions("node", "c").mapInArrow(chunks, "node binary, first long, ids string")
    return joined.repartition("node").sortWithinPartitions("node", "first").mapInArrow(stream, "node binary, sha string")


def prefix_trie(conversations: DataFrame, family: int = 20, modulus: int = 4) -> DataFrame:
    """Columns conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row for each node."""
    bounded_batches(conversations.sparkSession)
    scratch = Scratch(conversations.sparkSession, "trie")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = conversations.select(F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), key.alias("key"), words.alias("words")).where("c is not null")
    convs, turns = rebuild(positions(rows, scratch), scratch, family, modulus)

    # Refinement: runs of turns 1, 2-3, 4-7, 8-15, ...
    active = convs.where("len > 0").select("c", F.lit(ROOT).alias("class"))
    nodes, paths, retired, at = [], [], [], 1
    sized = with_hot(convs, "len")
    while True:
        last = 2 * at - 1
        run = turns.where(F.col("pos").between(at, last))
        if "hot" in sized.columns:  # turns of a very long conversation that is retired are not shuffled again
            run = run.join(F.broadcast(sized.where("hot").join(active, "c", "left_anti").select("c")), "c", "left_anti")
        path = scratch.write(split(run.join(active, "c")), "path")
        if is_empty(path):
            break
        found = path.groupBy("pos", "node").agg(F.min("c").alias("conv_id"), F.count("*").alias("n"), F.min("parent").alias("parent"), F.min("words").alias("words"))
        nodes.append(scratch.write(found, "nodes"))
        alone = nodes[-1].where("n = 1").groupBy(F.col("conv_id").alias("c")).agg(F.min("pos").alias("since"))
        retired.append(scratch.write(alone, "retired"))
        paths.append(path)
        # Who goes on: members of a class of several that have a turn at the run's end.
        active = scratch.write(path.where(F.col("pos") == last).join(retired[-1], "c", "left_anti").select("c", F.col("node").alias("class")), "active")
        at = 2 * at
        if is_empty(active):
            break

    def union(parts: list[DataFrame], schema: str) -> DataFrame:
        out = conversations.sparkSession.createDataFrame([], schema) if not parts else parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    all_nodes = union(nodes, "pos long, node binary, conv_id long, n long, parent binary, words long")
    all_paths = union(paths, "c long, pos long, node binary, parent binary, words long")
    singles = union(retired, "c long, since long")

    # Nodes of several members, the root among them, whatever it has.
    top = convs.agg(F.min("c").alias("conv_id"), F.count("*").alias("n")).where("n > 0")
    root = top.select(F.lit(0).cast("long").alias("pos"), F.lit(ROOT).alias("node"), "conv_id", "n", F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("words"))
    children = all_nodes.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"))
    several = all_nodes.where("n > 1").unionByName(root).join(children, "node", "left").withColumn("children", F.coalesce("children", F.lit(0)))
    several = scratch.write(several, "several")

    # Each conversation's way through these: its depths there, its class at each.
    ways = all_paths.select("c", "pos", "node").join(singles, "c", "left").where("since is null or pos < since").select("c", "pos", "node")
    ways = scratch.write(ways.unionByName(convs.select("c", F.lit(0).cast("long").alias("pos"), F.lit(ROOT).alias("node"))), "ways")
    # Fold back: what a conversation adds at the nodes that it stands for, and its leaf.
    gains = several.select(F.col("conv_id").alias("c"), "pos", ((F.col("n") - 1) * F.col("words")).alias("gain"), F.when(F.col("children") == 0, 1).otherwise(0).alias("leaf"))
    below = ways.join(gains, ["c", "pos"], "left").join(singles.select("c", F.lit(1).alias("alone")), "c", "left")
    down = Window.partitionBy("c").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = lambda x: F.sum(F.coalesce(x, F.lit(0))).over(down)
    sums = below.select("node", part(F.col("gain")).alias("saved"), (part(F.col("leaf")) + F.coalesce("alone", F.lit(0))).alias("leaves"))
    sums = sums.groupBy("node").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    ends = hash_lists(ways.join(convs, "c").where("pos = len"))
    several = several.join(sums, "node").join(ends, "node", "left")
    several = scratch.write(several, "folded")

    # Nodes below a class of several need that class's name; each name is held once.
    names = with_hot(scratch.write(several.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "children"), "names"), "children").drop("children")
    of_several = join_unique(several, names, "parent", "left").select(
        "conv_id", F.col("pos").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(NOTHING)).alias("ends_sha256")
    )
    heads = all_nodes.where("n = 1").join(singles, (F.col("conv_id") == F.col("c")) & (F.col("pos") == F.col("since"))).select("c", "parent")
    heads = join_unique(heads, names, "parent", "left").select("c", "parent_conv_id")
    # Tails: the retired conversations' turns from where they were alone.
    chains = singles.join(convs, "c").join(heads, "c")
    tail = join_unique(turns.select("c", "pos"), with_hot(scratch.write(chains, "chains"), "len"), "c", "inner").where("pos >= since")
    return of_several.unionByName(tail.select(F.col("c").alias("conv_id"), F.col("pos").alias("depth"), *_chain_columns()))


def _chain_columns() -> list[Column]:
    """A node of one member: its parent is its own up to the first, its end is the last."""
    end = F.col("pos") == F.col("len")
    one = F.lit(1).cast("long")
    return [
        F.when(F.col("pos") == F.col("since"), F.col("parent_conv_id")).otherwise(F.col("c")).alias("parent_conv_id"), one.alias("n_convs"), F.when(end, 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"), F.when(end, F.sha2(F.col("c").cast("string").cast("binary"), 256)).otherwise(NOTHING).alias("ends_sha256"),
    ]
