"""Conversation prefix trie: a pointer-jumping rollup over digest-keyed parent edges.

A node is a distinct sequence of first turns. Its key is a polynomial in the
SHA-256 digests of the turns, modulo the prime 2^127 - 1: such keys of two
pieces can be put together, so a conversation may lie in many partitions. Turns
are sorted by range, every partition chains its own, and what one hands to the
next (one row a partition) is added in a second pass. No task needs all turns
of a conversation, and no join has a conversation as its hot key.

Equal keys become one node, with a partial sum in every task. Leaves and savings
reach all ancestors by doubling: in round k a node adds the sums of those 2^k
levels below and takes its ancestor 2^k levels above as the next pointer, so a
depth of d takes log2(d) rounds, each of them a written table. Nodes of one
conversation need no rounds, their subtree has one leaf and saves nothing.
Ancestors that many nodes point to are looked up by broadcast: those with more
than a 256th of all pointers, so 256 at most.

Rows with a null conv_id take no part. Turns go by turn (null first), and those
of one turn by the digest of role and text; a repeated row is a turn each time.
A null role or text is the empty string, and an empty text is a turn. Very long
texts count whole. Other columns of the table, whatever their names, are not
read. An empty table has no root and gives an empty result. The digest of the
ends of one node is read by one task, as SHA-256 has no other way, in blocks of
bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenlake.llm.common import SharedTables, lookup, map_batches, texts_of

P = (1 << 127) - 1
BASE = 0x5DEECE66D2545F4914F6CDD1D5A3B1E7 % P
#: Ids of a block of ends.
BLOCK = 50_000
CHAIN = "part long, conv_id long, n long, k1 long, k2 long, p1 long, p2 long, words long, last boolean, first long, tail boolean"


def _halves(x: int) -> tuple[int, int]:
    low = x & 0xFFFFFFFFFFFFFFFF
    return x >> 64, low - (1 << 64) if low >> 63 else low


def _whole(high: int, low: int) -> int:
    return (high << 64) | (low & 0xFFFFFFFFFFFFFFFF)


def turn_digests(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, t1, t2 (digest of role and text), words of the text."""

    def one(batch: pa.RecordBatch) -> dict:
        found, words = [], []
        for role, text in zip(texts_of(batch, "role"), texts_of(batch), strict=True):
            found.append(_halves(int.from_bytes(hashlib.sha256(len(role).to_bytes(8, "little") + role + text).digest()[:16], "big") % P))
            words.append(len(text.split()))
        return {"conv_id": batch.column(0), "turn": batch.column(1), "t1": [x[0] for x in found], "t2": [x[1] for x in found], "words": words}

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return map_batches(rows.filter("conv_id IS NOT NULL"), one, "conv_id long, turn long, t1 long, t2 long, words long")


def _local(batches):
    """Rows (part, conv_id, t1, t2, words) of one partition, in order: the chain of each conversation from where this partition meets it."""
    part = first = conv = None
    n, value, power = 0, 0, 1
    held = None

    def batch_of(rows):
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int64()] * 8 + [pa.bool_(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in CHAIN.split(", ")])

    for batch in batches:
        out = []
        for p, c, t1, t2, words in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if c != conv:
                part, conv = p, c
                first = c if first is None else first
                n, value, power = 0, 0, 1
                if held is not None:
                    out.append((*held, True, first, False))
            elif held is not None:
                out.append((*held, False, first, False))
            before, n = value, n + 1
            value, power = (value + _whole(t1, t2) * power) % P, power * BASE % P
            held = (part, conv, n, *_halves(value), *_halves(before), words)
        if out:
            yield batch_of(out)
    if held is not None:
        yield batch_of([(*held, True, first, False), (*held, True, first, True)])


def _carried(ends: list) -> tuple[dict, set]:
    """From one row a partition, in order: what the first conversation of each brings along, and partitions whose last row isn't the last of its conversation."""
    carry, more, state, before = {}, set(), None, None
    for x in sorted(ends, key=lambda x: x.part):
        joined = state is not None and state[0] == x.first
        if joined:
            carry[x.part] = state
            more.add(before)
        n, value = x.n, _whole(x.k1, x.k2)
        if joined and x.conv_id == x.first:
            value = (state[2] + value * pow(BASE, state[1], P)) % P
            n += state[1]
        state, before = (x.conv_id, n, value), x.part
    return carry, more


def chained(rows: DataFrame, order: list[str], store: SharedTables, name: str) -> DataFrame:
    """conv_id, n (place from 1), key and parent key of each turn, words, and whether it is the last of its conversation."""
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    local = store.write(parts.select(F.spark_partition_id().cast("long").alias("part"), "conv_id", "t1", "t2", "words").mapInArrow(_local, CHAIN), name)
    carry, more = _carried(local.filter("tail").select("part", "conv_id", "n", "k1", "k2", "first").collect())  # one row a partition
    found = local.filter("NOT tail").select("part", "conv_id", "n", "k1", "k2", "p1", "p2", "words", "last")
    if not carry:
        return found.drop("part")
    ends = {x.part: x for x in local.filter("tail").select("part", "conv_id", "n").collect()} if more else {}

    def mended(batches):
        moved = np.array(sorted(set(carry) | more))
        for batch in batches:
            part = batch.column(0).to_numpy()
            if not np.isin(part, moved).any():
                yield batch
                continue
            rows = []
            for p, c, n, k1, k2, p1, p2, words, last in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if p in more and c == ends[p].conv_id and n == ends[p].n:
                    last = False
                if p in carry and carry[p][0] == c:
                    _, length, value = carry[p]
                    shift = pow(BASE, length, P)
                    k1, k2 = _halves((value + _whole(k1, k2) * shift) % P)
                    p1, p2 = _halves((value + _whole(p1, p2) * shift) % P)
                    n += length
                rows.append((p, c, n, k1, k2, p1, p2, words, last))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), batch.schema, strict=True)], schema=batch.schema)

    return found.mapInArrow(mended, found.schema).drop("part")


def keep_all(conv_id: Column) -> tuple[Column, Column]:
    """Conversations as they are: no turn is taken from another one."""
    return F.lit(0), conv_id


def rebuilt(turns: DataFrame, store: SharedTables, base: Callable[[Column], tuple[Column, Column]], most: int) -> tuple[DataFrame, DataFrame]:
    """The ids, and the turns (conv_id, own, n, t1, t2, words) after the first h of each come from another conversation.

    base gives, from an id, h (at most ``most``) and the id of the other one.
    """
    # each turn's digest is the chain from the turn before; kept beside its place
    placed = store.write(_placed(turns, store), "placed")
    ids = placed.filter("n = 1").select("conv_id")
    h, other = base(F.col("conv_id"))
    own = placed.filter(F.col("n") > h).select("conv_id", F.lit(1).alias("own"), "n", "t1", "t2", "words")
    heads = placed.filter(F.col("n") <= most).select(F.col("conv_id").alias("other"), "n", "t1", "t2", "words")
    taken = ids.select("conv_id", h.alias("h"), other.alias("other")).filter("h > 0").join(heads, "other").filter("n <= h")
    return ids, own.unionByName(taken.select("conv_id", F.lit(0).alias("own"), "n", "t1", "t2", "words"))


def _placed(turns: DataFrame, store: SharedTables) -> DataFrame:
    """conv_id, n (place from 1), t1, t2, words, numbered over the partitions of a range sort."""
    order = ["conv_id", "turn", "t1", "t2"]
    parts = turns.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().cast("long").alias("part"), "conv_id", "t1", "t2", "words")

    def number(batches):
        conv, n = None, 0
        for batch in batches:
            ids = batch.column(1).to_numpy()
            if not len(ids):
                continue
            new = np.concatenate([[conv is None or ids[0] != conv], ids[1:] != ids[:-1]])
            start = np.maximum.accumulate(np.where(new, np.arange(len(ids)), -1))
            place = np.arange(len(ids)) - start + 1
            place[start < 0] += n - 1  # goes on from the batch before
            conv, n = ids[-1], int(place[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], names=[*batch.schema.names, "n"])

    local = store.write(parts.mapInArrow(number, "part long, conv_id long, t1 long, t2 long, words long, n long"), "local")
    # one row a partition: its first and last conversation and how far the last one got
    ends = local.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "n")).alias("end")).collect()
    carry, state = {}, None
    for x in sorted(ends, key=lambda x: x.part):
        joined = state is not None and state[0] == x.first
        if joined:
            carry[x.part] = state
        state = (x.end.conv_id, x.end.n + (state[1] if joined and x.end.conv_id == x.first else 0))
    if not carry:
        return local.drop("part")
    added = local.sparkSession.createDataFrame([(p, c, n) for p, (c, n) in carry.items()], "part long, conv_id long, more long")
    return local.join(F.broadcast(added), ["part", "conv_id"], "left").withColumn("n", F.col("n") + F.coalesce("more", F.lit(0))).drop("part", "more")


def ends_digests(ends: DataFrame) -> DataFrame:
    """k1, k2, ends_sha256 of (k1, k2, conv_id): SHA-256 of the ids in order, joined by commas."""

    def blocks(batches):
        key, held, seq = None, [], 0
        names = ["part", "seq", "k1", "k2", "ids"]
        kinds = [pa.int64()] * 4 + [pa.string()]

        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        part = 0
        for batch in batches:
            out = []
            for p, k1, k2, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if held and ((k1, k2) != key or len(held) == BLOCK):
                    out.append((part, seq, *key, ",".join(map(str, held))))
                    held, seq = [], seq + 1
                key, part = (k1, k2), p
                held.append(c)
            if out:
                yield packed(out)
        if held:
            yield packed([(part, seq, *key, ",".join(map(str, held)))])

    def hashed(batches):
        key, sha = None, None
        for batch in batches:
            done = []
            for k1, k2, ids in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (k1, k2) != key:
                    if key is not None:
                        done.append((*key, sha.hexdigest()))
                    key, sha = (k1, k2), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["k1", "k2", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([sha.hexdigest()])], names=["k1", "k2", "ends_sha256"])

    order = ["k1", "k2", "conv_id"]
    sorted_ends = ends.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().cast("long").alias("part"), *order)
    made = sorted_ends.mapInArrow(blocks, "part long, seq long, k1 long, k2 long, ids string")
    by_key = made.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "part", "seq").select("k1", "k2", "ids")
    return by_key.mapInArrow(hashed, "k1 long, k2 long, ends_sha256 string")


def subtree_sums(shared: DataFrame, store: SharedTables, deepest: int) -> DataFrame:
    """k1, k2, leaves, saved summed over the subtree of every row of shared (k1, k2, p1, p2, depth, leaves, saved)."""
    cur, step, name = shared, 1, None
    n = shared.count()
    while step <= deepest:
        below = cur.filter(F.col("depth") >= step).groupBy("p1", "p2").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.count("*").alias("pointers"))
        below = store.write(below, f"below_{step}")
        summed = cur.join(below.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "more_leaves", "more_saved"), ["k1", "k2"], "left").select(
            "k1", "k2", "p1", "p2", "depth",
            (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
        )
        # only nodes at least 2 * step deep have a pointer after this round
        pointers = cur.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("p1").alias("q1"), F.col("p2").alias("q2"))
        far = lookup(summed.filter(F.col("depth") >= 2 * step), pointers, ["p1", "p2"], below.select("p1", "p2", F.col("pointers").alias("n")), n)
        far = far.select("k1", "k2", F.col("q1").alias("p1"), F.col("q2").alias("p2"), "depth", "leaves", "saved")
        done = summed.filter(F.col("depth") < 2 * step).select(*far.columns)
        cur = store.write(far.unionByName(done), f"round_{step}")
        store.drop(f"below_{step}", *([name] if name else []))
        name, step = f"round_{step}", 2 * step
    return cur.select("k1", "k2", "leaves", "saved")


def prefix_trie(conversations: DataFrame, base: Callable[[Column], tuple[Column, Column]] = keep_all, most: int = 0) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    base and most as in ``rebuilt``: conversations that take their first turns
    from others, by default none.
    """
    store = SharedTables(conversations.sparkSession, "prefix_trie")
    ids, turns = rebuilt(turn_digests(conversations), store, base, most)
    turns = store.write(turns, "turns")
    n_ids, least = ids.agg(F.count("*"), F.min("conv_id")).first()
    rows = chained(turns, ["conv_id", "own", "n"], store, "chain")

    root = [F.lit(0).cast("long").alias(x) for x in ("k1", "k2")]
    turnless = ids.join(rows.filter("n = 1").select("conv_id"), "conv_id", "left_anti").select(*root, "conv_id")
    ends = store.write(rows.filter("last").select("k1", "k2", "conv_id").unionByName(turnless), "end_rows")
    of_root = ends.filter("k1 = 0 AND k2 = 0").count()

    made = rows.groupBy("k1", "k2", "p1", "p2", F.col("n").alias("depth"), "words").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("last").cast("long")).alias("n_ends"))
    none = F.lit(None).cast("long")
    top = ids.sparkSession.range(1 if n_ids else 0).select(*root, none.alias("p1"), none.alias("p2"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), F.lit(least).cast("long").alias("conv_id"), F.lit(n_ids).cast("long").alias("n_convs"), F.lit(of_root).cast("long").alias("n_ends"))
    nodes = store.write(made.unionByName(top), "nodes")

    # of a parent: its children, and those that are one conversation's alone
    under = store.write(nodes.filter("depth > 0").groupBy("p1", "p2").agg(F.count("*").alias("n"), F.sum(F.when(F.col("n_convs") == 1, 1).otherwise(0)).alias("alone")), "under")
    shared = nodes.filter("n_convs > 1 OR depth = 0").join(under.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.col("n").alias("n_children"), "alone"), ["k1", "k2"], "left")
    shared = store.write(
        shared.select(
            "k1", "k2", "p1", "p2", "depth", "conv_id", F.coalesce("n_children", F.lit(0)).alias("n_children"),
            F.when(F.col("n_children").isNull(), 1).otherwise(F.col("alone")).cast("long").alias("leaves"),
            (F.greatest(F.col("n_convs") - 1, F.lit(0)) * F.col("words")).alias("saved"),
        ),
        "shared",
    )
    deepest = shared.agg(F.max("depth")).first()[0] or 0
    sums = subtree_sums(shared.select("k1", "k2", "p1", "p2", "depth", "leaves", "saved"), store, deepest)
    known = sums.join(shared.select("k1", "k2", "n_children"), ["k1", "k2"])

    n_nodes = nodes.count()
    parents = shared.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("of_parent"))
    named = lookup(nodes, parents, ["p1", "p2"], under.select("p1", "p2", "n"), n_nodes, how="left")
    digests = ends_digests(ends)
    return (
        named.join(known, ["k1", "k2"], "left")
        .join(digests, ["k1", "k2"], "left")
        .select(
            "conv_id",
            "depth",
            # a parent that isn't shared has the same one conversation
            F.when(F.col("depth") > 0, F.coalesce("of_parent", "conv_id")).alias("parent_conv_id"),
            "n_convs",
            F.coalesce("n_children", 1 - F.col("n_ends")).alias("n_children"),
            F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
            F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )
