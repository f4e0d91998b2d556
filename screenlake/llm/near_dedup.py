"""MinHash near-dedup by a multi-index Hamming join.

A document's set of word shingles gets a signature of 64 symbols of 16 bits.
Signatures are cut into 16 chunks of 4 symbols, and a document is filed under
every chunk with each of its symbols left out in turn, that is, with every
allowed chunk error enumerated. By the pigeonhole principle two signatures that
differ in at most 31 symbols have a chunk with one error or none and meet under
a key. Texts with a similarity of 0.75 differ in 16 symbols on average and in
more than 31 with a chance of about 1 in 50,000, and even then mostly meet.
Beside its signature a class carries how many of its shingles have each of 128
values of seven hash bits: two sets share at most the sum of the smaller counts,
so a pair whose sum is too small can't be similar, and that loses no link. All
other pairs that met are confirmed on full shingle sets, however many symbols
they differ in.

Only connected components are asked for, so no group is expanded into pairs:

1. Documents with equal sets are one class.
2. Keys are range-partitioned with the class as second sort column, which splits
   keys of any size, and one pass over each sorted partition drops keys that
   occur once. Each class is paired with the first class of most of its keys.
3. Components of the confirmed pairs. Keys whose classes are all in one
   component are done, however many classes those are.
4. Classes of different components under one key are compared by counts.
   A key with more than ``BUCKET`` classes would be quadratic, so its classes are
   joined exactly instead, whatever their signatures: two sets that are similar
   enough share one of their rarest shingles (the prefix filter of set joins; the
   smaller one even one of its rarest seventh). Shingles of one class alone drop
   out, and with them all that a family has beside its common text. Prefixes
   are compared by size and counts in the same way, in pairs of blocks if they
   still have more than ``BUCKET`` classes.

Documents without words have an empty set and are linked with nothing; a null
doc_id is linked with nothing, has no component and is kept. Rows that repeat a
doc_id are one document with several texts, linked through each of them. Very
long texts count whole. Other columns of the table, whatever their names, are
not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screenlake.llm.common import SharedTables, id_text, map_batches, texts_of
from screenlake.llm.components import components
from screenlake.llm.shingles import SYMBOLS, mix, shingle_set, signature, similar

PERCENT = 75
CHUNK = 4
CHUNKS = SYMBOLS // CHUNK
BUCKET = 2048
COUNTS = 128
#: Counts stop here, and say nothing from then on.
FULL = 2**16 - 1


def _features(batch: pa.RecordBatch) -> dict:
    z, texts = zstandard.ZstdCompressor(3), texts_of(batch)
    sets = [shingle_set(x) for x in texts]
    return {
        "doc_id": batch.column(0),
        "n_shingles": [len(x) for x in sets],
        "digest": [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets],
        "sig": [signature(x).tobytes() + counts(x).tobytes() if len(x) else None for x in sets],
        "packed": [z.compress(x) if len(y) else None for x, y in zip(texts, sets, strict=True)],
    }


def counts(shingles: np.ndarray) -> np.ndarray:
    """How many shingles have each value of the highest seven bits."""
    found = np.bincount((shingles >> np.uint64(57)).astype(np.int64), minlength=COUNTS)
    return np.minimum(found, FULL).astype(np.uint16)


def chunk_keys(sigs: np.ndarray) -> np.ndarray:
    """Keys of signatures (n, 64 symbols and more): one for each chunk and symbol left out."""
    chunks = sigs[:, :SYMBOLS].reshape(len(sigs), CHUNKS, CHUNK).astype(np.uint64)
    out = np.empty((len(sigs), CHUNKS, CHUNK), np.uint64)
    for left_out in range(CHUNK):
        packed = np.zeros(chunks.shape[:2], np.uint64)
        for s in range(CHUNK):
            if s != left_out:
                packed = packed << np.uint64(16) | chunks[:, :, s]
        place = (np.arange(CHUNKS, dtype=np.uint64) * np.uint64(CHUNK) + np.uint64(left_out)) << np.uint64(48)
        out[:, :, left_out] = mix(packed | place)
    return out.reshape(len(sigs), CHUNKS * CHUNK)


def _sigs(column: pa.Array) -> np.ndarray:
    """Signatures with the counts behind them."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SYMBOLS + COUNTS)


def _file(batches):
    """class_id under each of its keys."""
    for batch in batches:
        for i in range(0, batch.num_rows, 2048):
            part = batch.slice(i, 2048)
            keys = chunk_keys(_sigs(part.column(1)))
            ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], names=["key", "class_id"])


def _shingles(batches):
    """class_id, packed: a row for each shingle of each class."""
    z = zstandard.ZstdDecompressor()
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            part = batch.slice(i, 64)
            sets = [shingle_set(z.decompress(x)) for x in part.column(1).to_pylist()]
            size = np.array([len(x) for x in sets], np.int64)
            ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), size)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), pa.array(ids), pa.array(np.repeat(size, size))], names=["key", "class_id", "size"])


def _met(batches):
    """Rows sorted by key and class: those of keys that occur again, with the first class of the run.

    The first and the last run of a partition may go on in the next one and stay.
    """
    begun, carried, waiting = False, None, None  # carried: key and first class of a run that is out; waiting: a single row that may have company
    for batch in batches:
        if not batch.num_rows:
            continue
        key, cls = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if waiting is not None:
            key, cls = np.append(waiting[0], key), np.append(waiting[1], cls)
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        length = np.diff(np.append(start, len(key)))
        rep, keep = cls[start].copy(), length > 1
        if carried is not None and carried[0] == key[0]:
            rep[0], keep[0] = carried[1], True
        keep[0] |= not begun
        begun = True
        carried, waiting = ((key[-1], rep[-1]), None) if keep[-1] else (None, (key[-1], cls[-1]))
        each = np.repeat(keep, length)
        yield pa.RecordBatch.from_arrays([pa.array(key[each]), pa.array(cls[each]), pa.array(np.repeat(rep, length)[each])], names=["key", "class_id", "rep"])
    if waiting is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (waiting[0], waiting[1], waiting[1])], names=["key", "class_id", "rep"])


def _near(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Which rows of a have counts that allow the similarity with b (one row, or as many)."""
    x, y = a[:, SYMBOLS:], b[..., SYMBOLS:]
    both = np.minimum(x, y).sum(-1, dtype=np.int64)
    union = x.sum(-1, dtype=np.int64) + y.sum(-1, dtype=np.int64) - both
    return (100 * both >= percent * union) | (np.maximum(x, y).max(-1, initial=0) == FULL)


def _first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Place of the first key that signature a shares with each of b; some key must be shared."""
    differ = (b[:, :SYMBOLS] != a[:SYMBOLS]).reshape(-1, CHUNKS, CHUNK)
    chunk = (differ.sum(2) <= 1).argmax(1)
    return chunk * CHUNK + differ[np.arange(len(b)), chunk].argmax(1)


def _compare(percent: int, prefixes: bool = False):
    """Pairs of one key in different components whose counts allow the similarity; rows (key, class_id, comp, sig) are sorted by key, keys have BUCKET rows at most.

    The keys are those of the signatures, and a pair that shares several comes
    out under the first of them only. With prefixes they are shingles, and rows
    also have size and short: a pair counts if the smaller one is short.
    """
    def pairs(batch):
        key, cls, comp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        sig, found = _sigs(batch.column(3)), set()
        size, short = (batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 5)) if prefixes else (None, None)
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        for lo, hi in zip(start, np.append(start[1:], len(key)), strict=True):
            for i in range(lo, hi if prefixes else hi - 1):
                if prefixes:
                    if short[i]:
                        j = np.arange(lo, hi)
                        found |= _larger(cls[i], comp[i], size[i], sig[i], cls[j], comp[j], size[j], sig[j], percent)
                    continue
                j = np.arange(i + 1, hi)
                j = j[comp[j] != comp[i]]
                j = j[_near(sig[j], sig[i], percent)]
                if len(j):
                    j = j[chunk_keys(sig[i : i + 1])[0][_first_shared(sig[i], sig[j])].view(np.int64) == key[lo]]
                found.update((min(cls[i], cls[x]), max(cls[i], cls[x])) for x in j)
        return found

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            key = batch.column(0).to_numpy(zero_copy_only=False)
            cut = int(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))[-1])
            held, done = batch.slice(cut), batch.slice(0, cut)
            if cut and (found := pairs(done)):
                yield _edge_batch(found)
        if held is not None and (found := pairs(held)):
            yield _edge_batch(found)

    return run


def _edge_batch(found) -> pa.RecordBatch:
    a, b = zip(*sorted(found), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _larger(cls, comp, size, sig, others, comps, sizes, sigs, percent: int) -> set[tuple[int, int]]:
    """Pairs of one class with the others that are as large or larger, not too large, of other components, and have counts that allow the similarity."""
    at = np.flatnonzero((comps != comp) & (sizes >= size) & (percent * sizes <= 100 * size))
    at = at[_near(sigs[at], sig, percent)] if len(at) else at
    return {(min(int(cls), x), max(int(cls), x)) for x in others[at].tolist()}


def _compare_blocks(percent: int):
    """The same for two blocks of a large prefix; the rows to the left are short."""
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: set = set()
        if len(left) and len(right):
            s, t = _sigs(pa.array(left.sig)), _sigs(pa.array(right.sigs))
            other = [right[c].to_numpy() for c in ("class_ids", "comps", "sizes")]
            for i, (c, k, n) in enumerate(zip(left.class_id, left.comp, left["size"], strict=True)):
                found |= _larger(c, k, n, s[i], *other, t, percent)
        return pd.DataFrame(sorted(found), columns=["a", "b"]).astype("int64")

    return run


class NearDedup:
    """The steps over one table of documents; tables that a step writes stay in the shared folder."""

    def __init__(self, docs: DataFrame, percent: int = PERCENT, bucket: int = BUCKET):
        self.docs, self.percent, self.bucket = id_text(docs), percent, bucket
        self.store = SharedTables(docs.sparkSession, "near_dedup")

    def run(self) -> DataFrame:
        store = self.store
        rows = store.write(map_batches(self.docs, _features, "doc_id long, n_shingles long, digest binary, sig binary, packed binary", 1_000_000), "features")
        usable = rows.filter("doc_id IS NOT NULL AND n_shingles > 0")
        classes = store.write(usable.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.min("sig").alias("sig")), "classes")
        filed = classes.select("class_id", "sig").mapInArrow(_file, "key long, class_id long")
        met = store.write(filed.repartitionByRange("key", "class_id").sortWithinPartitions("key", "class_id").mapInArrow(_met, "key long, class_id long, rep long"), "met")
        texts = store.write(self._texts(met, classes, usable), "texts")
        # with each class, the first one that it shares most keys with
        firsts = met.filter("class_id <> rep").groupBy("class_id", "rep").agg(F.count("*").alias("n"))
        firsts = firsts.groupBy(F.col("class_id").alias("b")).agg(F.max_by("rep", F.struct("n", -F.col("rep"))).alias("a")).select("a", "b")
        # written in between, so that a task has one Python worker
        links = store.write(self._confirm(store.write(self._close(firsts, classes), "close"), texts), "links_1")
        links = links.union(self._same_id(usable, classes))
        labels = components(links, store, "comp_1")
        more = self._across(met, labels, classes, texts)
        links_2 = store.write(self._confirm(more.distinct(), texts), "links_2")
        if links_2.limit(1).count():
            labels = components(links.union(links_2), store, "comp_2")
        store.drop("mixed", "sets", "prefixes", "texts", "close", "links_1", "links_2")
        named = classes.join(labels.withColumnRenamed("id", "class_id"), "class_id", "left").select("digest", F.coalesce("component", "class_id").alias("component"))
        linked = usable.join(named, "digest").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
        alone = rows.filter("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        return linked.union(alone).select("*", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))

    def _texts(self, met: DataFrame, classes: DataFrame, usable: DataFrame) -> DataFrame:
        """Packed text of every class that met another one: that of its first document, which may have others."""
        wanted = met.select("class_id").distinct().join(classes.select("class_id", "digest"), "class_id")
        rows = usable.select(F.col("doc_id").alias("class_id"), "digest", "packed")
        return wanted.join(rows, ["class_id", "digest"]).select("class_id", "packed").dropDuplicates(["class_id"])

    def _close(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """Pairs whose counts allow the similarity."""
        sig = lambda x: classes.select(F.col("class_id").alias(x), F.col("sig").alias(f"sig_{x}"))

        percent = self.percent

        def near(batches):
            for batch in batches:
                ok = _near(_sigs(batch.column(2)), _sigs(batch.column(3)), percent)
                yield batch.select([0, 1]).filter(pa.array(ok))

        return pairs.join(sig("b"), "b").join(sig("a"), "a").select("a", "b", "sig_a", "sig_b").mapInArrow(near, "a long, b long")

    def _confirm(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """Pairs whose full sets are similar enough."""
        percent = self.percent
        text = lambda x: texts.select(F.col("class_id").alias(x), F.col("packed").alias(f"text_{x}"))

        def confirm(batches):
            z, last = zstandard.ZstdDecompressor(), (None, None)
            for batch in batches:
                ok = []
                for a, ta, tb in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                    if last[0] != a:
                        last = (a, shingle_set(z.decompress(ta)))
                    ok.append(similar(last[1], shingle_set(z.decompress(tb)), percent))
                yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

        return pairs.join(text("b"), "b").join(text("a"), "a").select("a", "b", "text_a", "text_b").mapInArrow(confirm, "a long, b long")

    def _same_id(self, usable: DataFrame, classes: DataFrame) -> DataFrame:
        """Links between the classes of one repeated doc_id."""
        own = usable.groupBy("doc_id", "digest").agg(F.count("*").alias("n")).join(classes.select("digest", "class_id"), "digest")
        firsts = own.groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("z")).filter("a <> z")
        return own.join(firsts, "doc_id").filter("a <> class_id").select("a", F.col("class_id").alias("b")).distinct()

    def _across(self, met: DataFrame, labels: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
        """Pairs under one key but in different components so far, whose counts allow the similarity."""
        store = self.store
        named = met.select("class_id").distinct().join(labels.withColumnRenamed("id", "class_id"), "class_id", "left").select("class_id", F.coalesce("component", "class_id").alias("comp"))
        open_keys = store.write(met.select("key", "class_id").distinct().join(named, "class_id").select("key", "class_id", "comp"), "open")
        store.drop("met")
        sizes = open_keys.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).filter("lo <> hi").select("key", "n")
        mixed = store.write(open_keys.join(sizes, "key"), "mixed")
        store.drop("open")
        small = mixed.filter(F.col("n") <= self.bucket).join(classes.select("class_id", "sig"), "class_id").select("key", "class_id", "comp", "sig")
        found = small.repartition("key").sortWithinPartitions("key").mapInArrow(_compare(self.percent), "a long, b long")
        large = mixed.filter(F.col("n") > self.bucket).select("class_id", "comp").distinct()
        if not large.limit(1).count():
            return found
        short = self._prefixes(large, texts).join(classes.select("class_id", "sig"), "class_id").select("key", "class_id", "comp", "sig", "size", "short", "n")
        few = short.filter(F.col("n") <= self.bucket).drop("n")
        found = found.union(few.repartition("key").sortWithinPartitions("key").mapInArrow(_compare(self.percent, True), "a long, b long"))
        blocks = short.filter(F.col("n") > self.bucket).withColumn("blocks", F.ceil(F.col("n") / self.bucket).cast("int")).withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
        each = blocks.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        rows = ("class_id", "comp", "sig", "size")
        left = each.filter("short").select("key", F.col("block").alias("i"), F.col("other").alias("j"), *rows)
        # under names of their own, as both come from one table
        right = each.select(F.col("key").alias("k"), F.col("other").alias("p"), F.col("block").alias("q"), *(F.col(c).alias(f"{c}s") for c in rows))
        return found.union(left.groupBy("key", "i", "j").cogroup(right.groupBy("k", "p", "q")).applyInPandas(_compare_blocks(self.percent), "a long, b long"))

    def _prefixes(self, wanted: DataFrame, texts: DataFrame) -> DataFrame:
        """key (a shingle), class_id, comp, size, short, n (classes of the key) for the shingles that a similar set must share one of.

        Of two similar sets the larger one has a shared shingle among its rarest
        size - ceil(p * size) + 1, the smaller one among size - ceil(2p / (1 + p) * size) + 1
        (short), p being the similarity and rare counting over the wanted classes.
        """
        p = self.percent
        sets = self.store.write(texts.join(wanted.select("class_id"), "class_id").select("class_id", "packed").mapInArrow(_shingles, "key long, class_id long, size long"), "sets")
        counted = sets.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
        by_class = Window.partitionBy("class_id")
        shared = sets.join(counted, "key").withColumn("last", F.count("*").over(by_class)).withColumn("i", F.row_number().over(by_class.orderBy("n", "key")))
        place = F.col("size") - F.col("last") + F.col("i")  # those that nobody shares come first
        prefix = shared.select("key", "class_id", "size", place.alias("place")).filter(f"place <= size - ({p} * size + 99) div 100 + 1")
        prefix = prefix.withColumn("short", F.expr(f"place <= size - ({2 * p} * size + {99 + p}) div {100 + p} + 1")).drop("place").join(wanted, "class_id")
        kept = prefix.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("short").alias("any"), F.count("*").alias("n")).filter("lo <> hi AND any").select("key", "n")
        return self.store.write(prefix.join(kept, "key"), "prefixes")


def near_dedup(docs: DataFrame, percent: int = PERCENT, bucket: int = BUCKET) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    return NearDedup(docs, percent, bucket).run()
