"""Exact dedup by a tree-merge of sorted digest runs.

Each input partition makes a sorted run of digests, each with the row that stays
so far. A run is written in blocks of ``BLOCK`` digests, cut where a shard of
the digest space ends. In each round two runs meet (binomial rounds: run i and
run i + 2^r of a tree), and one pass over their blocks, in order of their first
digests, merges them: what is smaller than the first digest of the next block is
final, so a task holds as many blocks as runs meet. Equal digests become one
row at every level, with the best row so far, so a digest with many copies never
has more rows in a task than there are runs to merge. No task merges more than
one shard.

Two texts are the same if SHA-256 and length of the normalised text agree.
Null texts count as empty, and empty texts are equal. A null doc_id sorts after
all others. Rows that repeat a doc_id are rows like any other; those that agree
in doc_id and length with the one that stays are all marked kept. Very long
texts count whole. Other columns of the table, whatever their names, are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlake.llm.common import SharedTables, id_text, map_batches, texts_of

#: The characters that don't count: \x20 and \x09-\x0D.
IGNORED = b" \t\n\x0b\x0c\r"
#: A digest with its length, and of the row that stays the code points and the doc_id (none: it is null).
ROW = np.dtype([("key", "S40"), ("size", "<i8"), ("id", "<i8"), ("none", "?"), ("n", "<i8")])
RUN = "shard long, run long, first binary, rows binary"
BLOCK = 4096


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars (code points of the original), norm_len (bytes), digest."""

    def one(batch: pa.RecordBatch) -> dict:
        norm = [x.translate(None, IGNORED) for x in texts_of(batch)]
        return {
            "doc_id": batch.column(0),
            "n_chars": pc.fill_null(pc.utf8_length(batch.column(1)), 0).cast(pa.int64()),
            "norm_len": [len(x) for x in norm],
            "digest": [hashlib.sha256(x).digest() for x in norm],
        }

    return map_batches(id_text(docs), one, "doc_id long, n_chars long, norm_len long, digest binary")


def collapse(rows: np.ndarray) -> np.ndarray:
    """Sorted rows with equal keys as one: the most code points, then the smallest id, and all counts."""
    new = np.ones(len(rows), bool)
    new[1:] = rows["key"][1:] != rows["key"][:-1]
    if new.all():
        return rows
    start = np.flatnonzero(new)
    best = rows[np.lexsort((rows["id"], rows["none"], -rows["size"], np.cumsum(new)))][start]
    best["n"] = np.add.reduceat(rows["n"], start)
    return best


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two sorted arrays of rows as one."""
    out = np.empty(len(a) + len(b), ROW)
    at = np.searchsorted(a["key"], b["key"], "right") + np.arange(len(b))
    from_a = np.ones(len(out), bool)
    from_a[at] = False
    out[at], out[from_a] = b, a
    return out


class _Blocks:
    """Gathers rows in order into blocks, each of one shard."""

    def __init__(self, shards: int | None = None):
        self.shards, self.held, self.count, self.of = shards, [], 0, (0, 0)

    def put(self, shard: int, run: int, rows: np.ndarray):
        if self.held and self.of != (shard, run):
            yield from self.flush()
        self.of = (shard, run)
        if len(rows):
            self.held.append(rows)
            self.count += len(rows)
        if self.count >= BLOCK:
            yield from self.flush()

    def flush(self):
        rows = np.concatenate(self.held) if self.held else np.zeros(0, ROW)
        self.held, self.count = [], 0
        for i in range(0, len(rows), BLOCK):
            part = rows[i : i + BLOCK]
            yield self.of[0], self.of[1], part["key"][:1].tobytes(), part.tobytes()


def _packed(blocks):
    for shard, run, first, rows in blocks:
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([run], pa.int64()), pa.array([first], pa.binary()), pa.array([rows], pa.binary())], names=["shard", "run", "first", "rows"])


def _runs(shards: int):
    """Rows (run, digest, norm_len, n_chars, doc_id) sorted by digest and length to the blocks of the run."""

    def blocks(batches):
        out, held, run = _Blocks(), np.zeros(0, ROW), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            run = batch.column(0)[0].as_py()
            rows = np.zeros(batch.num_rows, ROW)
            size = batch.column(2).to_numpy(zero_copy_only=False).astype(">i8").tobytes()
            rows["key"] = np.frombuffer(b"".join(d + size[8 * i : 8 * i + 8] for i, d in enumerate(batch.column(1).to_pylist())), "S40")
            rows["size"], rows["n"] = batch.column(3).to_numpy(zero_copy_only=False), 1
            rows["none"] = batch.column(4).is_null().to_numpy(zero_copy_only=False)
            rows["id"] = pc.fill_null(batch.column(4), 0).to_numpy(zero_copy_only=False)
            rows = collapse(np.concatenate([held, rows]))
            held, done = rows[-1:], rows[:-1]  # the last digest may go on
            yield from _sharded(out, done, run, shards)
        yield from _sharded(out, held, run, shards)
        yield from out.flush()

    return lambda batches: _packed(blocks(batches))


def _sharded(out: _Blocks, rows: np.ndarray, run: int, shards: int):
    if not len(rows):
        return
    high = np.frombuffer(rows["key"].astype("S4").tobytes(), ">u4").astype(np.int64)
    shard = high * shards >> 32
    start = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
    for lo, hi in zip(start, np.append(start[1:], len(rows)), strict=True):
        yield from out.put(int(shard[lo]), run, rows[lo:hi])


def _merged(batches):
    """Blocks sorted by shard, run and first digest: all blocks of one shard and run are merged."""

    def blocks():
        out, waiting, of = _Blocks(), np.zeros(0, ROW), None
        for batch in batches:
            for shard, run, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                block = np.frombuffer(data, ROW)
                if of is not None and of != (shard, run):
                    yield from out.put(*of, waiting)
                    waiting = waiting[:0]
                of = (shard, run)
                # no later block has anything before the first digest of this one
                final = np.searchsorted(waiting["key"], block["key"][0], "left")
                yield from out.put(*of, waiting[:final])
                waiting = collapse(merge(waiting[final:], block))
        if of is not None:
            yield from out.put(*of, waiting)
        yield from out.flush()

    return _packed(blocks())


def _unpacked(batches):
    names = ["digest", "norm_len", "keep_len", "keep_id", "group_size"]
    for batch in batches:
        for data in batch.column(3).to_pylist():
            rows = np.frombuffer(data, ROW)
            raw = np.frombuffer(rows["key"].tobytes(), np.uint8).reshape(-1, 40)
            digest = [x.tobytes() for x in np.ascontiguousarray(raw[:, :32])]
            size = np.ascontiguousarray(raw[:, 32:]).view(">i8").ravel().astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(size), pa.array(rows["size"]), pa.array(rows["id"], mask=rows["none"]), pa.array(rows["n"])], names=names)


def tree_merge(hashed: DataFrame, fan_in: int = 2) -> DataFrame:
    """digest, norm_len, keep_len, keep_id, group_size: one row per distinct text."""
    shards = max(int(hashed.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    runs = max(hashed.rdd.getNumPartitions(), 1)
    rows = hashed.select(F.spark_partition_id().cast("long").alias("run"), "digest", "norm_len", "n_chars", "doc_id")
    found = "digest binary, norm_len long, keep_len long, keep_id long, group_size long"
    # the run of each partition, before anything is exchanged
    step, df = _runs(shards), rows.sortWithinPartitions("digest", "norm_len")
    while runs > 1:
        df = df.mapInArrow(step, RUN).withColumn("run", F.floor(F.col("run") / fan_in)).repartition(shards, "shard", "run").sortWithinPartitions("shard", "run", "first")
        step, runs = _merged, -(-runs // fan_in)
    return df.mapInArrow(lambda batches: _unpacked(step(batches)), found)


def exact_dedup(docs: DataFrame, fan_in: int = 2) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, keep_len (code points of the row that stays).

    Of equal texts the row with the most code points stays, then the smallest
    doc_id. An empty table gives an empty result.
    """
    store = SharedTables(docs.sparkSession, "exact_dedup")
    hashed = store.write(digests(docs), "digests")
    best = store.write(tree_merge(hashed, fan_in), "best")
    return hashed.join(best, ["digest", "norm_len"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_len"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "keep_len",
    )
