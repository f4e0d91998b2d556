"""Suffix-array dedup: maximal repeats of at least ``least`` bytes over a whole corpus.

A sparse suffix array, sampled so that nothing is missed: of every window of
``least`` bytes the 40-byte gram with the smallest hash is an anchor, so equal
windows have equal anchors at the same place. Only anchors whose gram occurs
again matter, and of those only the context of ``least`` bytes around them.

1. Every text gives its anchors: gram hash, hash of the context, text key and
   place. A text that a task meets again is only counted.
2. Anchors are range-partitioned by gram and context, which splits grams of any
   frequency, and one pass drops grams that occur once.
3. A context that occurs twice is a repeat as a whole. For grams with several
   contexts, one text of each context gives its bytes.
4. Each such gram's contexts are its part of an enhanced suffix array: sorted to
   the right of the anchor, with common prefix lengths. A stack scan gives the
   common-prefix intervals; inside an interval the left sides, sorted the same
   way, show by their diversity how far the repeat goes to the left. Intervals of
   ``least`` bytes or more are the maximal repeats, with all their occurrences.
   A gram with more than ``HOT`` contexts is not gathered but split: a repeat has
   some number of bytes to the left of the anchor, the range of that number is
   cut into ``PARTS`` parts, and contexts are filed under the bytes that all
   repeats of a part have in common. Contexts alone under theirs are done with;
   of contexts that are equal as far as the part reaches, which are repeats
   already, one goes on. Groups of ``HOT`` or fewer get the interval scan, the
   rest are split again; a part of one number ends it, as equal bytes are all it has.
5. The covered bytes of every text are the union of its occurrences. All repeats
   around an anchor include it, so their union is one run for each context, and
   only that is written when just the covered bytes are asked for.

Strings are judged on the input; matches never cross texts; a text may repeat
itself, with overlaps. Null texts count as empty. Texts with the same bytes
share a 128-bit key, so repeated rows and ids, or null ids, do no harm. Very
long texts count whole. Other columns of the table, whatever their names, are
not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlake.llm.common import SharedTables, bound_batches, id_text, map_batches, pieces, texts_of
from screenlake.llm.shingles import mix

LEAST = 200
GRAM = 40
HOT = 256
PARTS = 4
STEP = 1 << 20
#: Bytes of texts met again that a task keeps before it counts them.
HELD = 32 << 20
BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_random = np.random.Generator(np.random.Philox(key=200))
TABLES = _random.integers(0, 2**64, (2, 256), np.uint64)
_powers: dict = {}


def _prefix(raw: np.ndarray, which: int):
    """A function that hashes raw[s:e] for arrays of s and e."""
    n = len(raw) + 1
    if which not in _powers or len(_powers[which][0]) < n:
        size, pair = max(n, 1 << 16), []
        for base in (BASES[which], pow(BASES[which], -1, 1 << 64)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            pair.append(np.multiply.accumulate(x))
        _powers[which] = pair
    up, down = _powers[which]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(TABLES[which][raw] * up[: len(raw)])])
    return lambda s, e: mix((total[e] - total[s]) * down[s])


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best over every run of width entries."""
    w, count = 1, len(x) - width + 1
    while w * 2 <= width:
        x = best(x[:-w], x[w:])
        w *= 2
    return best(x[:count], x[width - w : width - w + count])


def anchors(text: bytes, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Place, gram hash, context hash, bytes of context to the left and to the right (from the anchor on)."""
    found: list[tuple] = []
    windows, side = len(text) - least + 1, least - gram
    for base in range(0, windows, STEP):
        last = min(base + STEP, windows)
        lo, hi = max(0, base - side), min(len(text), last + 2 * least)
        raw = np.frombuffer(text, np.uint8, hi - lo, lo)
        grams = _prefix(raw, 0)
        at = np.arange(base - lo, last - lo + side)
        h = grams(at, at + gram)
        low = _sliding(h, side + 1, np.minimum)
        pad = np.zeros(side, np.uint64)
        picked = np.flatnonzero(_sliding(np.concatenate([pad, low, pad]), side + 1, np.maximum) == h)
        place = picked + base
        left, right = np.minimum(side, place), np.minimum(least, len(text) - place)
        ctx = _prefix(raw, 1)(place - left - lo, place + right - lo)
        found.append((place, h[picked], mix(ctx + (left * 1024 + right).astype(np.uint64)), left, right))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    if len(found) == 1:
        return found[0]
    out = [np.concatenate(x) for x in zip(*found, strict=True)]
    _, first = np.unique(out[0], return_index=True)
    return tuple(x[first] for x in out)


def text_key(text: bytes) -> tuple[int, int]:
    x = np.frombuffer(hashlib.blake2b(text, digest_size=16).digest(), "<i8")
    return int(x[0]), int(x[1])


def _pack_place(place, left, right):
    return (place << 20) | (left << 10) | right


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid)
    return lo


def intervals(strings: list[bytes]) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Order of the strings, and the common-prefix intervals (first, last, depth) of that order by a stack scan."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    lcp = [common(strings[a], strings[b]) for a, b in zip(order, order[1:], strict=False)]
    out, stack = [], []
    for i, depth in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][1] > depth:
            first, d = stack.pop()
            out.append((first, i, d))
        if not stack or stack[-1][1] < depth:
            stack.append((first, depth))
    return order, [x for x in out if x[2] >= 0]


def maximal_repeats(lefts: list[bytes], rights: list[bytes], least: int) -> list[tuple[list[int], int, int]]:
    """(members, bytes to the left, bytes to the right) of all maximal repeats of at least ``least`` bytes around one anchor.

    lefts are reversed, so a common prefix is a common end.
    """
    out = []
    order, found = intervals(rights)
    for first, last, r in found:
        inside = order[first : last + 1]
        if r + max(len(lefts[m]) for m in inside) < least:
            continue
        order_l, found_l = intervals([lefts[m] for m in inside])
        for f, t, left in found_l:
            if left + r >= least:
                members = [inside[m] for m in order_l[f : t + 1]]
                # all sharing more to the right: a deeper interval has them
                if len(members) == len(inside) or common(min(rights[m] for m in members), max(rights[m] for m in members)) == r:
                    out.append((members, left, r))
    return out


def _digest(x: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True)


def _found_in_groups(least: int, merged: bool):
    """Rows (set, gram, ctx, left, right, like) of one set after another, at most HOT contexts each, to the repeats around the anchor, or with merged to their union for each context."""
    names = ["gram", "ctx", "l", "r", *(() if merged else ("repeat", "like"))]

    def group(rows):
        lefts, rights = [x[3][::-1] for x in rows], [x[4] for x in rows]
        found = maximal_repeats(lefts, rights, least)
        if merged:
            most: dict = {}
            for members, left, right in found:
                for m in members:
                    l, r = most.get(m, (0, 0))
                    most[m] = (max(l, left), max(r, right))
            for m, (l, r) in most.items():
                yield rows[m][1], rows[m][2], l, r
            return
        for members, left, right in found:
            name = _digest(lefts[members[0]][:left][::-1] + rights[members[0]][:right])
            for m in members:
                yield rows[m][1], rows[m][2], left, right, name, rows[m][5]

    def run(batches):
        held: list = []
        for batch in batches:
            out = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if held and held[0][0] != row[0]:
                    out += group(held)
                    held = []
                held.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=names)
        if held and (out := list(group(held))):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=names)

    return run


def parts_of(lo: int, hi: int, parts: int) -> list[tuple[int, int]]:
    """The range lo to hi, both included, cut into so many parts at most."""
    step = -(-(hi - lo + 1) // parts)
    return [(a, min(hi, a + step - 1)) for a in range(lo, hi + 1, step)]


PART = "gram long, lo long, hi long, key long, like long, l long, r long, ctx long"
PART_KEYS = ["gram", "lo", "hi", "key"]


def _split(least: int, parts: int):
    """Rows (gram, ctx, lo, hi, left, right): each part of lo to hi in which the context has windows.

    key: what windows of that part have in common, like: all that they reach,
    l and r: how far that is on both sides of the anchor.
    """
    def run(batches):
        names = [x.split()[0] for x in PART.split(", ")]
        for batch in batches:
            out = []
            for gram, ctx, low, high, left, right in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                n = len(left)
                for lo, hi in parts_of(low, high, parts):
                    l, r = min(hi, n), min(least - lo, len(right))
                    if l >= lo and least - l <= len(right):
                        out.append((gram, lo, hi, _digest(left[n - lo :] + right[: least - hi]), _digest(left[n - l :] + right[:r]), l, r, ctx))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=names)

    return run


def _collapse(batches):
    """Sorted rows (gram, ctx, t1, t2, at, n): equal rows become one, with n added, and rows of grams that occur once go.

    The first and the last gram of a partition may have company in the next one and stay.
    """
    first, carried, waiting = None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        if waiting is not None:
            batch = pa.Table.from_batches([waiting, batch]).combine_chunks().to_batches()[0]
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
        new_gram = np.concatenate([[True], cols[0][1:] != cols[0][:-1]])
        new = new_gram.copy()
        for c in cols[1:5]:
            new[1:] |= c[1:] != c[:-1]
        # the last distinct row may go on and waits
        at = np.flatnonzero(new)
        n = np.add.reduceat(cols[5], at)
        cols = [c[at] for c in cols[:5]] + [n]
        start = np.flatnonzero(new_gram[at])
        length = np.diff(np.append(start, len(at)))
        each = np.repeat(length > 1, length) | (n > 1)
        if first is None:
            first = cols[0][0]
        if cols[0][0] == first or carried is not None and carried == cols[0][0]:
            each[: length[0]] = True
        schema = batch.schema
        waiting = pa.RecordBatch.from_arrays([pa.array(c[-1:]) for c in cols], schema=schema)
        if len(at) > 1:
            if length[-1] > 1:
                carried = cols[0][-1]
            elif not (carried is not None and carried == cols[0][-1]):
                carried = None
            yield pa.RecordBatch.from_arrays([pa.array(c[:-1][each[:-1]]) for c in cols], schema=schema)
    if waiting is not None:
        yield waiting


ROW = "gram long, ctx long, t1 long, t2 long, at long, n long"


class Repeats:
    """Finds repeats of at least ``least`` bytes in docs(doc_id, text)."""

    def __init__(self, docs: DataFrame, least: int = LEAST, gram: int = GRAM, hot: int = HOT):
        if not gram <= least <= 1000:
            raise ValueError("gram <= least <= 1000 is needed")
        self.docs, self.least, self.gram, self.hot = id_text(docs), least, gram, hot
        self.store, self.parts = SharedTables(docs.sparkSession, "repeats"), []

    def _anchors(self) -> DataFrame:
        least, gram = self.least, self.gram

        def rows(texts: list[tuple[tuple[int, int], bytes, int]]):
            """The anchors of texts with their key and how often they count."""
            out = []
            for key, x, n in texts:
                place, h, ctx, left, right = anchors(x, least, gram)
                if len(place):
                    out.append((h.view(np.int64), ctx.view(np.int64), np.full(len(place), key[0]), np.full(len(place), key[1]), _pack_place(place, left, right), np.full(len(place), n)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], names=[x.split()[0] for x in ROW.split(", ")])

        def run(batches):
            met, again, size = set(), {}, 0
            for batch in pieces(batches, 2_000_000):
                fresh = []
                for x in texts_of(batch):
                    if len(x) < least:
                        continue
                    key = text_key(x)
                    if key not in met:
                        met.add(key)
                        fresh.append((key, x, 1))
                    elif key in again:
                        again[key] = (x, again[key][1] + 1)
                    else:
                        again[key], size = (x, 1), size + len(x)
                yield from rows(fresh)
                if size > HELD:
                    yield from rows([(k, x, n) for k, (x, n) in again.items()])
                    again, size = {}, 0
            yield from rows([(k, x, n) for k, (x, n) in again.items()])

        order = ("gram", "ctx", "t1", "t2", "at")
        bound_batches(self.docs.sparkSession)
        own = self.store.write(self.docs.mapInArrow(run, ROW), "anchors")
        return self.store.write(own.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_collapse, ROW), "met")

    def _packed(self) -> DataFrame:
        def pack(batch: pa.RecordBatch) -> dict:
            z, texts = zstandard.ZstdCompressor(3), texts_of(batch)
            keys = [text_key(x) for x in texts]
            return {"doc_id": batch.column(0), "t1": [k[0] for k in keys], "t2": [k[1] for k in keys], "packed": [z.compress(x) for x in texts]}

        return map_batches(self.docs, pack, "doc_id long, t1 long, t2 long, packed binary")

    def _contexts(self, mixed: DataFrame) -> DataFrame:
        """gram, ctx, left, right: the bytes of one text of each context."""
        least, side = self.least, self.least - self.gram
        wanted = mixed.groupBy("t1", "t2").agg(F.collect_list(F.struct("gram", "ctx", "at")).alias("of"))

        def cut(batches):
            z = zstandard.ZstdDecompressor()
            for batch in batches:
                for i in range(0, batch.num_rows, 64):
                    part, rows = batch.slice(i, 64), []
                    for of, packed in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                        text = z.decompress(packed)
                        for x in of:
                            p = x["at"] >> 20
                            rows.append((x["gram"], x["ctx"], text[max(0, p - side) : p], text[p : p + least]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["gram", "ctx", "left", "right"])

        # one of equal texts is enough, and it is dealt as the join needs it
        texts = self._packed().groupBy("t1", "t2").agg(F.first("packed").alias("packed"))
        return wanted.join(texts, ["t1", "t2"]).select("of", "packed").mapInArrow(cut, "gram long, ctx long, left binary, right binary")

    def _scanned(self, sets: DataFrame, merged: bool) -> DataFrame:
        """The interval scan over each set of contexts."""
        out = "gram long, ctx long, l long, r long" + ", repeat long, like long" * (not merged)
        return sets.repartition("set").sortWithinPartitions("set").mapInArrow(_found_in_groups(self.least, merged), out)

    def _split_hot(self, contexts: DataFrame, merged: bool) -> list[DataFrame]:
        """The repeats of grams with more than hot contexts."""
        store, found, level = self.store, [], 0
        texts = contexts.select("gram", "ctx", "left", "right")
        many = contexts.filter(F.col("contexts") > self.hot).select("gram", "ctx", F.lit(0).alias("lo"), F.lit(self.least - self.gram).alias("hi"))
        # ends as every level has narrower parts, and those of a single number have no group of two
        while many.limit(1).count():
            level += 1
            self.parts += [f"parts_{level}", f"groups_{level}"]
            rows = many.join(texts, ["gram", "ctx"]).select("gram", "ctx", "lo", "hi", "left", "right")
            parts = store.write(rows.mapInArrow(_split(self.least, PARTS), PART), f"parts_{level}")
            groups = parts.groupBy(*PART_KEYS, "like", "l", "r").agg(F.min("ctx").alias("ctx"), F.count("*").alias("n"))
            sizes = groups.groupBy(*PART_KEYS).agg(F.count("*").alias("size"), F.sum("n").alias("all")).filter("all > 1").drop("all")
            groups = store.write(groups.join(sizes, PART_KEYS), f"groups_{level}")
            alike = [*PART_KEYS, "like", "l", "r"]
            found.append(parts.join(groups.filter("n > 1").select(alike), alike).withColumn("repeat", F.col("like")))
            least = F.lit(self.least)
            few = groups.filter(F.col("size").between(2, self.hot)).join(texts, ["gram", "ctx"])
            # no further than the part reaches, as far as those go that were taken for one
            ends = (F.expr("substring(left, length(left) - l + 1, l)").alias("left"), F.substring("right", F.lit(1), (least - F.col("lo")).cast("int")).alias("right"))
            name = F.xxhash64(*alike)
            scanned = self._scanned(few.select(F.xxhash64(*PART_KEYS).alias("set"), "gram", "ctx", *ends, name.alias("like")), merged)
            if not merged:
                members = parts.join(groups.select(alike), alike).select(name.alias("like"), "gram", F.col("ctx").alias("own"))
                scanned = scanned.join(members, ["gram", "like"]).withColumn("ctx", F.col("own"))
            found.append(scanned)
            many = groups.filter(F.col("size") > self.hot).select("gram", "ctx", "lo", "hi")
        return found

    def occurrences(self, merged: bool = False) -> DataFrame:
        """t1, t2 (text key), start, end, repeat (names the repeated string; null: the whole context of an anchor).

        With merged, the repeats around one anchor come as one run, without a name.
        """
        store, least = self.store, self.least
        met = self._anchors()
        first = F.min(F.struct("t1", "t2", "at")).alias("first")
        classes = store.write(met.groupBy("gram", "ctx").agg(F.sum("n").alias("n"), first).select("gram", "ctx", "n", "first.*"), "classes")
        mixed = classes.groupBy("gram").agg(F.count("*").alias("contexts")).filter("contexts > 1")
        contexts = store.write(self._contexts(classes.join(mixed, "gram").select("gram", "ctx", "t1", "t2", "at")).join(mixed, "gram"), "contexts")
        few = contexts.filter(F.col("contexts") <= self.hot).select(F.col("gram").alias("set"), "gram", "ctx", "left", "right", F.lit(0).cast("long").alias("like"))
        columns = ["gram", "ctx", "l", "r", "repeat"][: 4 if merged else 5]
        found = self._scanned(few, merged).select(columns)
        for more in self._split_hot(contexts, merged):
            found = found.union(more.select(columns))
        if merged:  # all of them include the anchor
            found = found.groupBy("gram", "ctx").agg(F.max("l").alias("l"), F.max("r").alias("r"))
        whole = classes.filter("n > 1").select("gram", "ctx", F.expr("shiftright(at, 10) & 1023").alias("l"), F.expr("at & 1023").alias("r"), F.lit(None).cast("long").alias("repeat"))
        spans = store.write(whole.select(columns).union(found), "spans")
        store.drop("contexts", "anchors", *self.parts)
        placed = met.select("gram", "ctx", "t1", "t2", F.shiftright("at", 20).alias("p")).join(spans, ["gram", "ctx"])
        return placed.select("t1", "t2", (F.col("p") - F.col("l")).alias("start"), (F.col("p") + F.col("r")).alias("end"), *columns[4:])

    def covered(self) -> DataFrame:
        """t1, t2, spans: the merged covered runs of every text that has some, in order."""
        merged = F.aggregate(
            F.array_sort(F.collect_set(F.struct("start", "end"))),
            F.expr("cast(array() as array<struct<start:long,end:long>>)"),
            lambda done, x: F.when(
                (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= x["start"]),
                F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end")))),
            ).otherwise(F.concat(done, F.array(x))),
        )
        return self.occurrences(merged=True).groupBy("t1", "t2").agg(merged.alias("spans"))

    def removed(self, with_text: bool = False) -> DataFrame:
        """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes if asked for."""
        def cut(batches):
            z = zstandard.ZstdDecompressor()
            for batch in batches:
                for i in range(0, batch.num_rows, 256):
                    part, rows = batch.slice(i, 256), []
                    for doc_id, packed, spans in zip(*(part.column(c).to_pylist() for c in range(3)), strict=True):
                        text, at, kept = z.decompress(packed), 0, []
                        for s in spans or []:
                            kept.append(text[at : s["start"]])
                            at = s["end"]
                        kept = b"".join([*kept, text[at:]])
                        rows.append((doc_id, len(text), len(text) - len(kept), len(spans or []), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
                    cols = list(zip(*rows, strict=True))[: 5 + with_text]
                    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=False)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text])

        spans = self.store.write(self.covered(), "covered")
        schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
        return self._packed().join(spans, ["t1", "t2"], "left").select("doc_id", "packed", "spans").mapInArrow(cut, schema)
