"""Fuzzy passages by collinear chaining of shared word k-mers.

1. Every text is cut at anchors: of every ``window`` consecutive k-mers (``k``
   words) the one with the smallest hash. Each anchor goes out twice, with
   hashes of the anchors after it and of those before it.
2. Anchors are range-partitioned by seed and these neighbours, which splits
   seeds of any frequency. Every occurrence of a seed makes a match with the one
   before it in this order, so two that agree longest meet, and one with the
   first that agrees in all ``DEPTH`` neighbours; so a passage in n texts makes at most 4 n
   matches for each seed and not n squared, and copies that end in different
   places still meet the texts that they share most with.
3. The matches of two texts are chained: sorted by the place in one text, each
   takes the best chain that ends before it and within the gap in both texts,
   kept in a Fenwick tree over the places in the other, less a cost for the gap. All
   chains come out, those of one match too, and each match is in one of them.
4. The chains of two texts, in one row, meet 8-bit hashes of the words of both and are
   aligned: the words between seeds by banded edit distance, the ends through edits for
   up to ``REACH`` words. A chain of too low identity is cut at its worst gap.
   Chains of ``min_words`` words and ``min_identity`` are fuzzy passages.

What is certain to be found: 21 equal words hold an anchor, from which a passage grows
both ways, through every edit with four equal words or more to the next one. An edit less
than 4 words from an end cuts that end off, and an end may be a word too far in one of 256
cases; where a text says one word over and over, that is as many words. Beyond that, of 300
pairs of passages each with edits at random places, found at all, and whole but for 4
words at each end: 51 words, 2 edits 0.84 and 0.84; 60, 5 edits 0.97 and 0.85; 80, 8 edits
1.00 and 0.84; 120, 12 edits 1.00 and 0.79; 200, 40 edits 0.99 and 0.04. Texts that share a
passage but have closer partners before and after every seed of it are paired with those.

A text without ``k`` words has no seeds. Null and empty texts have no passages.
A passage that a text repeats within itself counts. Rows that repeat a doc_id
are one document; a null doc_id takes no part, and its row has no spans. Very
long texts count whole. Other columns of the table, whatever their names, are
not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import deque
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlake.llm.common import SharedTables, id_text, map_batches, texts_of
from screenlake.llm.repeats import _sliding
from screenlake.llm.shingles import mix, word_hashes

K = 6
WINDOW = 16
MIN_WORDS = 50
MIN_IDENTITY = 0.8
#: A gap of so many words ends a chain.
MAX_GAP = 40
#: Neighbouring anchors on one side that matches are chosen by.
DEPTH = 4
#: Words that an end grows by at most.
REACH = 64
#: Matches of two texts in one row, more or less; a longer chain is a row of its own.
MOST = 4096
#: Chains whose ends grow side by side.
SIDE_BY_SIDE = 16_384
_places = np.random.Generator(np.random.Philox(key=66)).integers(0, 2**64, 64, np.uint64) | np.uint64(1)


def seeds(text: bytes, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Place (in words) and hash of the anchors, and 8-bit hashes of all words."""
    w = word_hashes(text)
    packed = (w & np.uint64(0xFF)).astype(np.uint8).tobytes()
    n = len(w) - k + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), packed
    h = w[:n] * _places[0]
    for i in range(1, k):
        h = h + w[i : i + n] * _places[i]
    h = mix(h)
    if n <= window:
        at = np.array([int(h.argmin())])
    else:
        low = _sliding(h, window, np.minimum)
        pad = np.zeros(window - 1, np.uint64)
        at = np.flatnonzero(_sliding(np.concatenate([pad, low, pad]), window, np.maximum) == h)
    return at, h[at], packed


def context(h: np.ndarray) -> np.ndarray:
    """16 bits of each of the next DEPTH anchors, the nearest one in front; 0 where there is none."""
    short = np.concatenate([h >> np.uint64(48), np.zeros(DEPTH, np.uint64)])
    out = np.zeros(len(h), np.uint64)
    for i in range(1, DEPTH + 1):
        out = out << np.uint64(16) | short[i : i + len(h)]
    return out


class Fenwick:
    """Largest (score, index) over a prefix of places."""

    def __init__(self, n: int):
        self.best = [(0.0, -1)] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def upto(self, i: int) -> tuple[float, int]:
        """Over places below i."""
        found = (0.0, -1)
        while i:
            if self.best[i] > found:
                found = self.best[i]
            i -= i & -i
        return found


def chain(xs: list[int], ys: list[int], k: int = K, max_gap: int = MAX_GAP, gap_cost: float = 0.1) -> list[list[int]]:
    """Chains of matches (x in one text, y in the other), best first; indexes in order.

    A match adds k words less gap_cost for each word between it and the match
    before. With the potential score + gap_cost * (x + y) the cost is linear,
    and the best predecessor is a prefix maximum over y in the Fenwick tree. If
    that one is over max_gap words away, the best of those within the gap is
    taken: at most max_gap + k places of y, each with its matches in falling
    order of potential, so that the old ones can leave in front.
    """
    order = sorted(range(len(xs)), key=lambda i: (xs[i], ys[i]))
    places = sorted(set(ys))
    rank = {y: i for i, y in enumerate(places)}
    tree, near = Fenwick(len(places)), [deque() for _ in places]
    reach = max_gap + k
    score, before = [0.0] * len(xs), [-1] * len(xs)
    done = 0  # matches of order that can be predecessors
    for i in order:
        x, y = xs[i], ys[i]
        # matches with the same x are no predecessors of each other
        while xs[order[done]] < x:
            j = order[done]
            value, r = (score[j] + gap_cost * (xs[j] + ys[j]), j), rank[ys[j]]
            tree.put(r, value)
            while near[r] and near[r][-1] < value:
                near[r].pop()
            near[r].append(value)
            done += 1
        r = rank[y]
        found = tree.upto(r)
        if found[1] >= 0 and (x - xs[found[1]] > reach or y - ys[found[1]] > reach):
            found = (0.0, -1)
            while r and y - places[r - 1] <= reach:
                r -= 1
                while near[r] and x - xs[near[r][0][1]] > reach:
                    near[r].popleft()
                if near[r] and near[r][0] > found:
                    found = near[r][0]
        own, (potential, j) = float(k), found
        if j >= 0 and (linked := potential - gap_cost * (x + y) + k) > own:
            own, before[i] = linked, j
        score[i] = own
    used, out = [False] * len(xs), []
    for i in sorted(range(len(xs)), key=lambda i: (-score[i], xs[i], ys[i])):
        one = []
        while i >= 0 and not used[i]:
            used[i] = True
            one.append(i)
            i = before[i]
        if one:
            out.append(one[::-1])
    return out


def in_line(x: np.ndarray, y: np.ndarray, start: np.ndarray, k: int = K, gap_cost: float = 0.1) -> np.ndarray:
    """Which runs of matches, each sorted by x, are one chain without a search: one after the other on one diagonal, with gaps that cost less than a match adds.

    Through its neighbour a match gains k over any earlier predecessor, so the chain has them all.
    """
    off = x - y
    step = np.diff(x, prepend=x[:1])
    step[start] = 1
    same_line = np.minimum.reduceat(off, start) == np.maximum.reduceat(off, start)
    return same_line & (2 * gap_cost * np.maximum.reduceat(step, start) < k) & (np.minimum.reduceat(step, start) > 0)


def edit_distance(a: list[int], b: list[int], band: int = 24) -> int:
    """Words to insert, delete or replace, within a band around the diagonal."""
    if a == b:
        return 0
    n = same(a, b)
    a, b = a[n:], b[n:]
    if (n := same(a[::-1], b[::-1])):
        a, b = a[:-n], b[:-n]
    if not len(a) or not len(b):
        return len(a) + len(b)
    band = max(band, abs(len(a) - len(b)) + 1)
    size, far = len(b), 1 << 30
    row = [j if j <= band else far for j in range(size + 1)]
    for i in range(1, len(a) + 1):
        new, word, left = [far] * (size + 1), a[i - 1], far
        for j in range(max(0, i - band), min(size, i + band) + 1):
            best = min(row[j], left) + 1
            if j:
                best = min(best, row[j - 1] + (word != b[j - 1]))
            new[j] = left = best
        row = new
    return row[size]


def same(a, b) -> int:
    """How many words agree from the start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def extend(a: bytes, b: bytes, band: int = 8, edit: int = 3, drop: int = 18) -> tuple[int, int, int]:
    """Words of a and of b that belong to a passage ending where they begin, and the edits in them.

    A word that agrees counts 1, an edit -3; the best sum is taken, and the search
    ends where all sums are ``drop`` below it.
    """
    start = same(a, b)
    a, b = a[start:], b[start:]
    size = len(b)
    if not len(a) or not size:
        return start, start, 0
    # a cell is 256 * score + edits, so that one addition and one comparison do for both
    none, wrong = -(1 << 40), 1 - 256 * edit
    top, at, floor = start, (start, start, 0), 256 * (start - drop)
    row = [256 * start + j * wrong if j <= band else none for j in range(size + 1)]
    for i in range(1, len(a) + 1):
        new, word, left, alive = [none] * (size + 1), a[i - 1], none, False
        for j in range(max(0, i - band), min(size, i + band) + 1):
            best = (row[j] if row[j] > left else left) + wrong
            equal = j > 0 and word == b[j - 1]
            if j:
                last = row[j - 1] + (256 if equal else wrong)
                if last > best:
                    best = last
            left = none
            if best >= floor:
                new[j] = left = best
                alive = True
                if equal and best >> 8 >= top:
                    top, at = best >> 8, (start + i, start + j, best & 255)
                    floor = 256 * (top - drop)
        if not alive:
            break
        row = new
    return at


def extend_all(pairs: list[tuple[bytes, bytes]]) -> list[tuple[int, int, int]]:
    """extend of every pair."""
    if not pairs:
        return []
    tables, sizes = [], []
    for texts in zip(*pairs, strict=True):
        sizes.append(np.array([len(x) for x in texts]))
        tables.append(np.zeros((len(texts), sizes[-1].max()), np.uint8))
        tables[-1][np.arange(tables[-1].shape[1]) < sizes[-1][:, None]] = np.frombuffer(b"".join(texts), np.uint8)
    return [tuple(x) for x in grown(tables[0], sizes[0], tables[1], sizes[1]).tolist()]


def grown(a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray, band: int = 8, edit: int = 3, drop: int = 18) -> np.ndarray:
    """extend of each row of a and b, of which the first size words count, cell by cell for all rows side by side; those that are done leave after each word."""
    shared = min(a.shape[1], b.shape[1])
    equal = (a[:, :shared] == b[:, :shared]) & (np.arange(shared) < np.minimum(size_a, size_b)[:, None])
    start = np.where(equal.all(1), shared, equal.argmin(1)) if shared else np.zeros(len(a), np.int64)
    out = np.stack([start, start, np.zeros_like(start)], 1)
    rows = np.flatnonzero((size_a > start) & (size_b > start))
    if not len(rows):
        return out
    begun = start[rows].astype(np.int32)
    sizes = np.stack([size_a[rows] - begun, size_b[rows] - begun]).astype(np.int32)
    high = int(sizes[0].max())

    def after(words: np.ndarray, n: int, size: np.ndarray, none: int) -> np.ndarray:
        """n words of each row from where the rows begin to differ, a column a row."""
        at = begun[:, None] + np.arange(n)
        found = words[rows[:, None], np.minimum(at, words.shape[1] - 1)].astype(np.int16)
        found[np.arange(n) >= size[:, None]] = none
        return np.ascontiguousarray(found.T)

    words_a = after(a, high, sizes[0], -1)
    # beside the words of b stand band cells in front and behind, so that a row's cells are one slice
    words_b = np.full((high + 2 * band + 1, len(rows)), -2, np.int16)
    words_b[band : 2 * band + high] = after(b, high + band, sizes[1], -2)
    # a cell is 256 * score + edits, as in extend
    none, wrong, right, width = np.int32(-(1 << 29)), np.int32(1 - 256 * edit), np.int32(256), 2 * band + 1
    place = np.arange(-band, band + 1, dtype=np.int32)[:, None]  # cell q of row i is column i + q - band
    row = np.where(place >= 0, 256 * begun + place * wrong, none)
    # cells beyond the end of b reach none before it, and no word there agrees, so nothing is asked about them
    some, most = place[:, 0] >= 0, int(sizes[1].max())
    top = 256 * begun
    floor = top - 256 * drop
    for i in range(1, high + 1):
        word, new, left = words_a[i - 1], np.full_like(row, none), None
        now = np.zeros(width, bool)
        for q in range(max(0, band - i), min(width, most + 1 - i + band)):
            j, above = i + q - band, q + 1 < width and some[q + 1]
            if not some[q] and not above and left is None:
                continue
            best = np.full_like(top, none)
            if above or left is not None:
                best = (row[q + 1] if left is None else np.maximum(row[q + 1], left) if above else left) + wrong
            if j:
                equal = word == words_b[band + j - 1]
                if some[q]:
                    best = np.maximum(best, row[q] + np.where(equal, right, wrong))
                if (better := equal & (best >= top)).any():
                    top[better] = best[better] >> 8 << 8
                    at = begun[better]
                    out[rows[better]] = np.stack([at + i, at + j, best[better] & 255], 1)
                    floor[better] = top[better] - 256 * drop
            kept = best >= floor
            now[q] = kept.any()
            left = new[q] = np.where(kept, best, none)
            if not now[q]:
                left = None
        row, some = new, now
        on = (row > none).any(0) & (sizes[0] > i)
        n = np.count_nonzero(on)
        if not n:
            break
        if 4 * n < 3 * len(on):  # those that are done change nothing, so they leave by the quarter
            rows, begun, sizes, row, top, floor, words_a, words_b = rows[on], begun[on], sizes[:, on], row[:, on], top[on], floor[on], words_a[:, on], words_b[:, on]
    return out


def windows(words: np.ndarray, low: np.ndarray, high: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts from low to high in words, up to REACH words in front of first, the nearest first, and how many; the same behind last."""
    step, first, last = np.arange(REACH), np.minimum(first, high), np.minimum(last, high)
    return (
        words[np.maximum(first[:, None] - 1 - step, 0)], np.minimum(first - low, REACH),
        words[np.minimum(last[:, None] + step, len(words) - 1)], np.minimum(high - last, REACH),
    )


def beside(a: bytes, b: bytes, x: int, y: int, x_end: int, y_end: int) -> list[tuple[bytes, bytes]]:
    """The words of both texts in front of a chain, the nearest first, and those behind it."""
    return [(a[max(0, x - REACH) : x][::-1], b[max(0, y - REACH) : y][::-1]), (a[x_end : x_end + REACH], b[y_end : y_end + REACH])]


def align(a: bytes, b: bytes, xs: list[int], ys: list[int], min_words: int, min_identity: float, k: int = K, outer: list[tuple[int, int, int]] | None = None) -> list[tuple[int, int, int, int, float]]:
    """Start and end in both texts and the identity of the passages in a chain of places of seeds; a and b have the words.

    A chain of too low identity is cut at the gap with the most edits. outer: how
    far the ends of the whole chain grow, if that is known.
    """
    out, todo = [], [(0, len(xs))]
    wrong = [0] + [edit_distance(a[xs[i - 1] : xs[i]], b[ys[i - 1] : ys[i]]) for i in range(1, len(xs))]
    while todo:
        first, end = todo.pop()
        x, y, x_end, y_end = xs[first], ys[first], xs[end - 1] + k, ys[end - 1] + k
        whole = outer is not None and end - first == len(xs)
        (bx, by, bad), (ax, ay, bad_2) = outer if whole else [extend(*x) for x in beside(a, b, x, y, x_end, y_end)]
        x, y, x_end, y_end = x - bx, y - by, x_end + ax, y_end + ay
        edits = bad + bad_2 + sum(wrong[first + 1 : end])
        if min(x_end - x, y_end - y) < min_words:
            continue
        identity = 1 - edits / max(x_end - x, y_end - y)
        if identity >= min_identity:
            out.append((x, x_end, y, y_end, identity))
        elif end - first > 1:
            cut = max(range(first + 1, end), key=wrong.__getitem__)
            todo += [(first, cut), (cut, end)]
    return out


def _shared(batches):
    """Rows (seed, ctx, doc_id, at) in order: the matches of each row, the larger document first.

    The first row of a partition, the last one and the first one of its run are
    given with themselves, with seed and ctx: their runs may go on in another
    partition.
    """
    held, begun = None, False

    def pack(seed, ctx, one, two):
        flip = (one[0] < two[0]) | ((one[0] == two[0]) & (one[1] < two[1]))
        cols = [np.where(flip, q, p) for p, q in zip(one, two, strict=True)] + [np.where(flip, p, q) for p, q in zip(one, two, strict=True)]
        types = (pa.int64(), pa.int32()) * 2
        keys = [pa.nulls(len(flip), pa.int64()) if v is None else pa.array(v, pa.int64()) for v in (seed, ctx)]
        return pa.RecordBatch.from_arrays([*keys, *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["seed", "ctx", "doc_id", "at", "rep_id", "rep_at"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        old = 0 if held is None else len(held[0])
        if old:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        seed, ctx, doc, at = cols
        n = len(seed)
        row = np.arange(n)
        like = np.concatenate([[False], seed[1:] == seed[:-1]])
        made = [np.stack([row[like], row[like] - 1])]
        same_ctx = like & np.concatenate([[False], ctx[1:] == ctx[:-1]])
        start = np.maximum.accumulate(np.where(same_ctx, 0, row))
        new = start < row - 1
        made.append(np.stack([row[new], start[new]]))
        i, j = np.concatenate(made, 1)
        fresh = i >= old
        i, j = i[fresh], j[fresh]
        if not begun:
            begun = True
            yield pack(seed[:1], ctx[:1], (doc[:1], at[:1]), (doc[:1], at[:1]))
        if len(i):
            yield pack(None, None, (doc[i], at[i]), (doc[j], at[j]))
        keep = np.unique([start[-1], n - 1])
        held = [c[keep] for c in cols]
    if held is not None:
        yield pack(held[0], held[1], held[2:], held[2:])


def _aligned(batches, min_words: int, min_identity: float, k: int):
    """Rows (doc_id, rep_id, sizes, xs, ys, a_low, a, b_low, b), where a and b are words from place low on: the passages in the chains."""
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
    names = [x.split()[0] for x in FOUND.split(", ")]
    for batch in batches:
        doc_id, rep_id, a_low, b_low = (batch.column(i).to_numpy() for i in (0, 1, 5, 7))
        texts = batch.column(6).to_pylist(), batch.column(8).to_pylist()
        row = np.repeat(np.arange(len(doc_id)), batch.column(2).value_lengths().to_numpy())  # of each chain
        size = batch.column(2).flatten().to_numpy()
        if not len(size):
            continue
        end = np.cumsum(size)
        # of both texts: places in all words of the batch, these words, and where each text begins and stops
        sides, there = [], np.ones(end[-1], bool)
        for at, low, text in ((3, a_low, texts[0]), (4, b_low, texts[1])):
            n = np.array([len(x) for x in text])
            begin = np.cumsum(n) - n
            at = batch.column(at).flatten().to_numpy() + np.repeat((begin - low)[row], size)
            there &= at + k <= np.repeat((begin + n)[row], size)
            sides.append((at, np.frombuffer(b"".join(text), np.uint8), begin, begin + n))
        # where one id has several texts, a chain meets the words of all of them
        (at_a, words_a, *_), (at_b, words_b, *_) = sides
        for i in range(k):
            there[there] = words_a[at_a[there] + i] == words_b[at_b[there] + i]
        own = np.flatnonzero(np.logical_or.reduceat(there, end - size))
        for some in (own[i : i + SIDE_BY_SIDE] for i in range(0, len(own), SIDE_BY_SIDE)):
            of, last = row[some], end[some] - 1
            first = last + 1 - size[some]
            in_a, in_b = (windows(words, begin[of], stop[of], at[first], at[last] + k) for at, words, begin, stop in sides)
            front, back = (grown(*in_a[i : i + 2], *in_b[i : i + 2]) for i in (0, 2))
            low = [x[of] - begin[of] for x, (*_, begin, _) in zip((a_low, b_low), sides, strict=True)]
            start, stop_at = ([at[x] + side * grow[:, i] + plus + low[i] for i, (at, *_) in enumerate(sides)] for x, side, grow, plus in ((first, -1, front, 0), (last, 1, back, k)))
            length = [n - m for m, n in zip(start, stop_at, strict=True)]
            identity = 1 - (front[:, 2] + back[:, 2]) / np.maximum(*length)
            long = np.minimum(*length) >= min_words
            single = long & (size[some] == 1) & (identity >= min_identity)
            # two chains may grow to the same passage
            made = dict(zip(zip(*(x[single].tolist() for x in (doc_id[of], start[0], stop_at[0], rep_id[of], start[1], stop_at[1])), strict=True), identity[single].tolist(), strict=True))
            for c in np.flatnonzero(long & (size[some] > 1)).tolist():
                i = of[c]
                xs, ys = ((at[first[c] : last[c] + 1] - begin[i]).tolist() for at, _, begin, _ in sides)
                p, q = int(a_low[i]), int(b_low[i])
                for x, x_end, y, y_end, like in align(texts[0][i], texts[1][i], xs, ys, min_words, min_identity, k, [tuple(front[c].tolist()), tuple(back[c].tolist())]):
                    made[int(doc_id[i]), x + p, x_end + p, int(rep_id[i]), y + q, y_end + q] = float(like)
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*zip(*made, strict=True), made.values()], types, strict=True)], names=names)


SEED = "seed long, ctx long, doc_id long, at int"
MET = "seed long, ctx long, doc_id long, at int, rep_id long, rep_at int"
CHAIN = "doc_id long, rep_id long, sizes array<int>, xs array<int>, ys array<int>"
FOUND = "doc_id long, start int, end int, rep_id long, rep_start int, rep_end int, identity double"


class Passages:
    """Fuzzy passages of at least min_words words in docs(doc_id, text)."""

    def __init__(self, docs: DataFrame, min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY, k: int = K, window: int = WINDOW):
        self.docs, self.min_words, self.min_identity, self.k, self.window = id_text(docs), min_words, min_identity, k, window
        self.store = SharedTables(docs.sparkSession, "passages")

    def matches(self) -> DataFrame:
        """doc_id, at and the same of another occurrence (rep_): the matches of all shared seeds."""
        k, window = self.k, self.window

        def one(batch: pa.RecordBatch) -> dict:
            out: list[list] = [[np.zeros(0, np.int64)] for _ in range(4)]
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                at, h, _ = seeds(text, k, window)
                # the lowest bit of the seed says on which side the neighbours are
                for side, ctx in ((0, context(h)), (1, context(h[::-1])[::-1])):
                    for to, x in zip(out, (h & ~np.uint64(1) | np.uint64(side), ctx, np.full(len(at), doc_id), at), strict=True):
                        to.append(x.view(np.int64))
            return {f: pa.array(np.concatenate(x), t) for f, x, t in zip(("seed", "ctx", "doc_id", "at"), out, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)}

        # written, as dealing by range reads it twice
        found = self.store.write(map_batches(self.docs.filter("doc_id IS NOT NULL"), one, SEED, 2_000_000), "seeds")
        order = ("seed", "ctx", "doc_id", "at")
        met = self.store.write(found.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_shared, MET), "met")
        self.store.drop("seeds")
        # a few rows of each partition meet where a run spans partitions
        bounds = met.filter("seed IS NOT NULL").select(*order).distinct().coalesce(1).sortWithinPartitions(*order).mapInArrow(_shared, MET)
        return met.union(bounds).filter("doc_id <> rep_id OR at <> rep_at").select("doc_id", "at", "rep_id", "rep_at")

    def chains(self) -> DataFrame:
        """doc_id, rep_id, sizes, xs, ys: the matches in each chain of two texts and the places of their seeds, chain by chain. Chains of one match count."""
        k = self.k

        def pairs(batches):  # sorted by the two texts and the places; pairs of a single match leave as arrays
            held = None
            for batch in batches:
                cols = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
                cols = cols if held is None else np.concatenate([held, cols], 1)
                new = np.flatnonzero(np.concatenate([[True], (cols[:2, 1:] != cols[:2, :-1]).any(0)]))
                held = cols[:, new[-1] :]
                yield cols[:, : new[-1]], new
            if held is not None:
                yield held, np.array([0, held.shape[1]])

        def run(batches):
            types = (pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * 3)
            for cols, new in pairs(b for b in batches if b.num_rows):
                if not cols.shape[1]:
                    continue
                # a match is met on both sides
                fresh = np.ones(cols.shape[1], bool)
                fresh[1:] = (cols[:, 1:] != cols[:, :-1]).any(0)
                start = np.cumsum(fresh)[new[:-1]] - 1
                cols = cols[:, fresh]
                end = np.append(start[1:], cols.shape[1])
                plain = in_line(cols[2], cols[3], start, k)
                out = []
                for i in range(len(start)):
                    xs, ys = cols[2, start[i] : end[i]].tolist(), cols[3, start[i] : end[i]].tolist()
                    found = [range(len(xs))] if plain[i] else sorted(chain(xs, ys, k))
                    # rows of bounded size, of chains that begin near each other
                    for _, part in groupby(zip(accumulate(map(len, found)), found, strict=True), lambda c: c[0] // MOST):
                        some = [c for _, c in part]
                        out.append((cols[0, start[i]], cols[1, start[i]], [len(c) for c in some], [xs[j] for c in some for j in c], [ys[j] for c in some for j in c]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["doc_id", "rep_id", "sizes", "xs", "ys"])

        rows = self.matches().select("doc_id", "rep_id", "at", "rep_at")
        return rows.repartition("doc_id", "rep_id").sortWithinPartitions("doc_id", "rep_id", "at", "rep_at").mapInArrow(run, CHAIN)

    def passages(self) -> DataFrame:
        """doc_id, start, end, rep_id, rep_start, rep_end (in words), identity: one row for each passage and pair of texts that has it."""
        k, min_words, min_identity = self.k, self.min_words, self.min_identity

        def spell(batch: pa.RecordBatch) -> dict:
            return {"id": batch.column(0), "words": [(word_hashes(x) & np.uint64(0xFF)).astype(np.uint8).tobytes() for x in texts_of(batch)]}

        found = self.store.write(self.chains(), "chains")
        words = map_batches(self.docs.filter("doc_id IS NOT NULL"), spell, "id long, words binary", 2_000_000)
        words = words.groupBy("id").agg(F.collect_set("words").alias("all"))
        for name, ids, at in (("a", "doc_id", "xs"), ("b", "rep_id", "ys")):
            # the words of the chains and REACH more on both sides
            low = F.greatest(F.array_min(at) - REACH, F.lit(0))
            met = found.join(words, found[ids] == words["id"]).withColumn("w", F.explode("all")).withColumn(f"{name}_low", low)
            found = met.withColumn(name, F.substring("w", F.col(f"{name}_low") + 1, F.array_max(at) + k + REACH - F.col(f"{name}_low"))).drop("id", "all", "w")

        return found.select("doc_id", "rep_id", "sizes", "xs", "ys", "a_low", "a", "b_low", "b").mapInArrow(lambda batches: _aligned(batches, min_words, min_identity, k), FOUND)

    def report(self) -> DataFrame:
        """One row per document that shares a passage: doc_id, n_passages, n_words (covered by passages), rep_ids, spans (merged, in words)."""
        found = self.store.write(self.passages(), "passages")
        both = found.select("doc_id", "start", "end", F.col("rep_id").alias("other")).union(found.select("rep_id", "rep_start", "rep_end", F.lit(None).cast("long")))
        merged = F.aggregate(
            F.array_sort(F.collect_set(F.struct("start", "end"))),
            F.expr("cast(array() as array<struct<start:int,end:int>>)"),
            lambda done, x: F.when(
                (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= x["start"]),
                F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end")))),
            ).otherwise(F.concat(done, F.array(x))),
        )
        return (
            both.groupBy("doc_id")
            .agg(merged.alias("spans"), F.array_sort(F.collect_set("other")).alias("rep_ids"))
            .select("doc_id", F.size("spans").cast("long").alias("n_passages"), F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]).alias("n_words"), "rep_ids", "spans")
        )
