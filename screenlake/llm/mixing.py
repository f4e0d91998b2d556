"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells of source, language and topic. Raking scales
the token weights of the cells until the token shares of each of the three
match their targets. The weights become sampling probabilities, capped at 1 and
calibrated so that the expected tokens are a given share of all tokens, and a
document is drawn if a hash of its id and the seed is below its probability.

A topic is the nearest of ``TOPICS`` centroids over hashed words, weighted by
how rare they are and without what sets languages apart; the centroids are fitted on all
documents, repeated ones as often as they occur: each round is one pass over the
hashed words in Spark, whose sums are of rounded numbers, so that their order
does not matter; only products in single precision may differ in the last place.
Texts without words have the topic ``none``. Tokens are words, or what
the given counter says.

Counts cover all documents. Up to ``MAX_CELLS`` cells are raked on the driver,
one row a cell; more are raked in Spark, by the same steps. Nulls in source or
language are categories of their own. Documents without words have no tokens
but are drawn like the others of their cell; a cell without any token has
probability 1. A null id draws like any other id, and repeated ids are drawn or
left together. Very long texts count whole. No other column of the table is
touched, whatever its name. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenlake.llm.common import SharedTables, bound_batches, pieces, texts_of
from screenlake.llm.shingles import word_hashes

MAX_CELLS = 100_000
TOPICS = 8
DIM = 2048
COMMON = 4
#: Bytes of text that are cut into words at once.
PIECE = 2_000_000
#: Bits of a place among DIM, and the largest count of a word that fits beside it in two bytes.
PLACE = 11
MANY = 31
CHUNK = "codes binary, sizes binary, scale binary, far binary, roots binary"
#: Parts of one that sums over documents are rounded to; they are exact up to 2^33 documents.
UNIT = float(1 << 20)
#: Largest turn of a direction or centroid in a round after which no more rounds follow.
STILL = 1e-3
MARGINS = ("source", "lang", "topic")


def hashed_words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words of a text among DIM, with square roots of their counts."""
    n = np.bincount((word_hashes(text) & np.uint64(DIM - 1)).astype(np.int64), minlength=DIM)
    found = np.flatnonzero(n)
    return found, np.sqrt(n[found])


class Topics:
    """Centroids over hashed words weighted by rarity."""

    def __init__(self, rare: np.ndarray, centroids: np.ndarray):
        self.rare, self.centroids = rare, centroids

    @classmethod
    def fit(cls, vectors: DataFrame, store: SharedTables, topics: int = TOPICS, rounds: int = 15) -> Topics:
        """Spherical k-means over all of vectors(h, at, n) on what is left without the COMMON main directions, begun with the first rows.

        The main directions are those of languages and styles, which are margins
        of their own; centroids are at right angles to them.
        """
        vectors = vectors.filter(F.length("at") > 0)
        seen = _summed(vectors.select("at"), _counted, DIM + 1)
        rare = np.log((1 + seen[-1]) / (1 + seen[:-1])).astype(np.float32)
        chunks = store.write(vectors.select("at", "n").mapInArrow(_packed(rare), CHUNK), "chunks")
        most = max(topics, 2 * COMMON)
        first = vectors.select("h", "at", "n").mapInArrow(_first(most), "h long, at binary, n binary").distinct().orderBy("h", "at", "n").limit(most).collect()
        x = np.zeros((len(first), DIM), np.float32)
        for i, r in enumerate(first):
            x[i, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["n"], "<f4")
        unit = lambda y: y / np.maximum(np.linalg.norm(y, axis=1), 1e-9)[:, None]
        x = unit(x * rare)
        if not len(x):
            return cls(rare, x)
        main = principal(x[: 2 * COMMON].T, lambda y: _summed(chunks, _turned(y, rare), y.size).reshape(y.shape))
        centers = unit(x - (x @ main) @ main.T)[:topics]
        for _ in range(rounds):
            sums = _summed(chunks, _gathered(main, centers, rare), DIM * len(centers)).reshape(len(centers), DIM)
            sums = sums - (sums @ main) @ main.T
            held, centers = centers, np.where(np.linalg.norm(sums, axis=1)[:, None] > 0, unit(sums), centers)
            if np.linalg.norm(centers - held, axis=1).max() < STILL:
                break
        store.drop("chunks")
        return cls(rare, centers.astype(np.float32))

    def name(self, at: np.ndarray, value: np.ndarray) -> str:
        if not len(at) or not len(self.centroids):
            return "none"
        return f"topic{int((self.centroids[:, at] @ (value * self.rare[at])).argmax())}"


def principal(start: np.ndarray, times: Callable[[np.ndarray], np.ndarray], rounds: int = 20) -> np.ndarray:
    """The COMMON main directions of the documents, from the columns of start; times: their matrix of products times some columns.

    Block Lanczos: the products of all rounds are kept, and each round takes the
    best directions within all of them, so few rounds do.
    """
    block = np.linalg.qr(start)[0]
    basis, products, main = np.zeros((len(start), 0)), np.zeros((len(start), 0)), block
    for _ in range(rounds):
        basis, products = np.concatenate([basis, block], 1), np.concatenate([products, times(block)], 1)
        inner = basis.T @ products
        value, mixed = np.linalg.eigh((inner + inner.T) / 2)
        held, main = main, basis @ mixed[:, ::-1][:, :COMMON]
        rest = products[:, -block.shape[1] :]
        for _ in range(2):  # twice, so that rounding leaves nothing of the basis
            rest = rest - basis @ (basis.T @ rest)
        left, size, _ = np.linalg.svd(rest, full_matrices=False)
        block = left[:, size > 1e-6 * max(value[-1], 1e-300)][:, : len(start) - basis.shape[1]]
        if not block.shape[1] or np.linalg.norm(held[:, :COMMON] - main @ (main.T @ held[:, :COMMON])) < STILL:
            break
    return main


def _counted(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Documents that have each word, and all documents."""
    yield np.append(np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u2"), minlength=DIM), batch.num_rows)


def _first(most: int) -> Callable:
    """The first distinct rows of a task, in order: those of all tasks have the first ones of the table."""

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            h = batch.column(0)
            if len(held) == most:
                batch = batch.filter(pc.less_equal(h, held[-1][0]))
            if batch.num_rows:
                held = sorted({*held, *zip(*(c.to_pylist() for c in batch.columns), strict=True)})[:most]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["h", "at", "n"])

    return run


def _packed(rare: np.ndarray, rows: int = 128) -> Callable:
    """Documents in chunks of so many, two bytes a word, as each round reads them all.

    codes: place and count of each word, sizes: words of each document, scale: one
    over the length that a document has when weighted by rarity, far and roots: the
    words with over MANY counts, which have the code of count 0.
    """

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                at = part.column(0).to_pylist()
                sizes = np.array([len(x) // 2 for x in at], "<u2")
                at = np.frombuffer(b"".join(at), "<u2")
                roots = np.frombuffer(b"".join(part.column(1).to_pylist()), "<f4")
                count = np.rint(roots * roots)
                far = np.flatnonzero(count > MANY)
                codes = at | np.where(count > MANY, 0, count).astype("<u2") << np.uint16(PLACE)
                scale = 1 / np.maximum(np.sqrt(np.bincount(np.repeat(np.arange(len(sizes)), sizes), (roots * rare[at]) ** 2)), 1e-9)
                made = (codes.astype("<u2"), sizes, scale.astype("<f4"), far.astype("<u4"), roots[far])
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in made], names=[x.split()[0] for x in CHUNK.split(", ")])

    return run


def _dense(batch: pa.RecordBatch, weight: np.ndarray, rare: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each chunk with a row a document, until the next one is asked for, and the factors that give its rows length 1. weight: of each code."""
    held = np.zeros(0, np.float32)
    for one in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        codes, sizes, scale, far, roots = (np.frombuffer(x, t) for x, t in zip(one, ("<u2", "<u2", "<f4", "<u4", "<f4"), strict=True))
        held = held if len(held) >= len(sizes) * DIM else np.empty(len(sizes) * DIM, np.float32)
        x = held[: len(sizes) * DIM]
        x.fill(0)
        place = codes & np.uint16(DIM - 1)
        at = np.repeat(np.arange(0, len(x), DIM), sizes) + place
        x[at] = weight[codes]
        if len(far):
            x[at[far]] = roots * rare[place[far]]
        yield x.reshape(len(sizes), DIM), scale


def _weights(rare: np.ndarray) -> np.ndarray:
    """The weight of every code of place and count."""
    return (np.sqrt(np.arange(MANY + 1, dtype=np.float32))[:, None] * rare).ravel()


def _turned(main: np.ndarray, rare: np.ndarray) -> Callable:
    """Sums of each document times its products with the columns of main."""
    main = main.astype(np.float32)

    def one(batch):
        for x, scale in _dense(batch, _weights(rare), rare):
            yield np.rint((x.T @ (x @ main * (scale * scale)[:, None])).astype(float).ravel() * UNIT)

    return one


def _gathered(main: np.ndarray, centers: np.ndarray, rare: np.ndarray) -> Callable:
    """Sums of the documents nearest to each centre, scaled so that they have length 1 when main is taken out of them."""
    columns, k = np.concatenate([centers.T, main], 1).astype(np.float32), len(centers)

    def one(batch):
        for x, scale in _dense(batch, _weights(rare), rare):
            found = x @ columns * scale[:, None]
            left = np.sqrt(np.maximum(1 - (found[:, k:] ** 2).sum(1), 0))
            own = np.zeros((len(x), k), np.float32)
            own[np.arange(len(x)), found[:, :k].argmax(1)] = np.where(left > 1e-3, scale / np.maximum(left, 1e-3), 0)  # nothing is left of the others
            yield np.rint((own.T @ x).astype(float).ravel() * UNIT)

    return one


def _summed(rows: DataFrame, one: Callable, size: int, reducers: int = 16) -> np.ndarray:
    """Sum of the arrays that one gives for batches: a row a task is shuffled, and one a reducer reaches the driver."""

    def total(batches: Iterator, one: Callable) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for batch in batches:
            for x in one(batch):
                out += x
        yield pa.RecordBatch.from_arrays([pa.array([out.astype("<f8").tobytes()], pa.binary())], names=["sums"])

    given = lambda batch: (np.frombuffer(x, "<f8") for x in batch.column(0).to_pylist())
    parts = rows.mapInArrow(lambda b: total(b, one), "sums binary")
    found = parts.repartition(reducers).mapInArrow(lambda b: total(b, given), "sums binary").collect()
    return np.sum([np.frombuffer(r["sums"], "<f8") for r in found], axis=0) if found else np.zeros(size)


def words_of(texts: list[bytes]) -> list[int]:
    return [len(x.split()) for x in texts]


def measured(text: str, tokens: Callable[[list[bytes]], list[int]] = words_of) -> Column:
    """Struct of n_tokens and the hashed words of a text column: h (a hash of the text), at, n."""

    @F.arrow_udf("struct<n_tokens:long,h:long,at:binary,n:binary>")
    def measure(column: pa.Array) -> pa.Array:
        n_tokens, h, at, n = [], [], [], []
        # the words of a whole batch would take ten times its bytes, which the worker keeps for later tasks
        for piece in pieces(iter([pa.RecordBatch.from_arrays([column], names=["text"])]), PIECE):
            texts = texts_of(piece)
            n_tokens += tokens(texts)
            h += map(zlib.crc32, texts)
            for places, roots in map(hashed_words, texts):
                at.append(places.astype("<u2").tobytes())
                n.append(roots.astype("<f4").tobytes())
        arrays = [pa.array(n_tokens, pa.int64()), pa.array(h, pa.int64()), pa.array(at, pa.binary()), pa.array(n, pa.binary())]
        pa.default_memory_pool().release_unused()
        return pa.StructArray.from_arrays(arrays, names=["n_tokens", "h", "at", "n"])

    return measure(F.col(f"`{text}`").cast("string"))


def topic_of(topics: Topics, at: str, n: str) -> Column:
    """The topic of hashed words."""

    @F.arrow_udf("string")
    def named(at: pa.Array, n: pa.Array) -> pa.Array:
        return pa.array([topics.name(np.frombuffer(x, "<u2"), np.frombuffer(y, "<f4")) for x, y in zip(at.to_pylist(), n.to_pylist(), strict=True)], pa.string())

    return named(at, n)


def tempered(tokens: np.ndarray, index: np.ndarray, power: float) -> np.ndarray:
    """Target shares of one margin: its shares of tokens to a power, scaled to sum 1."""
    share = np.bincount(index, tokens)
    share = np.where(share > 0, (share / max(share.sum(), 1)) ** power, 0)
    return share / max(share.sum(), 1e-300)


def rake(tokens: np.ndarray, indexes: list[np.ndarray], targets: list[np.ndarray], rounds: int = 200, tolerance: float = 1e-9) -> np.ndarray:
    """Weights of the cells with which each margin's token shares match its targets."""
    weight, total = np.ones(len(tokens)), tokens.sum()
    for _ in range(rounds):
        worst = 0.0
        for index, target in zip(indexes, targets, strict=True):
            now = np.bincount(index, tokens * weight, len(target))
            factor = np.divide(target * total, now, out=np.ones(len(target)), where=now > 0)
            worst = max(worst, np.abs(factor - 1).max(initial=0))
            weight *= factor[index]
        if worst < tolerance:
            break
    return weight


def calibrate(tokens: np.ndarray, weight: np.ndarray, keep_share: float) -> np.ndarray:
    """Probabilities min(1, c * weight) with keep_share of the tokens expected."""
    if keep_share >= 1 or not tokens.sum():
        return np.ones(len(tokens))
    goal, low, high = keep_share * tokens.sum(), 0.0, 1.0
    while (np.minimum(1, high * weight) * tokens).sum() < goal and high < 1e18:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if (np.minimum(1, mid * weight) * tokens).sum() < goal else (low, mid)
    return np.where(tokens > 0, np.minimum(1, high * weight), 1.0)


def probabilities(cells: DataFrame, power: float, keep_share: float, targets: dict[str, dict] | None = None) -> DataFrame:
    """One row a cell: its margins and probability. cells: the margins and tokens; targets: shares by margin, else tempered ones."""
    rows = cells.limit(MAX_CELLS + 1).collect()
    if len(rows) > MAX_CELLS:
        return _in_spark(cells, power, keep_share, targets)
    rows.sort(key=lambda r: [(r[m] is None, r[m] or "") for m in MARGINS])
    tokens = np.array([r.tokens for r in rows], float)
    indexes, shares = [], []
    for m in MARGINS:
        places: dict = {}
        index = np.array([places.setdefault(r[m], len(places)) for r in rows], int)
        indexes.append(index)
        if targets and m in targets:
            own = np.array([float(targets[m].get(x, 0)) for x in places])
            shares.append(own / max(own.sum(), 1e-300))
        else:
            shares.append(tempered(tokens, index, power))
    p = calibrate(tokens, rake(tokens, indexes, shares), keep_share) if rows else []
    made = [(*(r[m] for m in MARGINS), float(x)) for r, x in zip(rows, p, strict=True)]
    return F.broadcast(cells.sparkSession.createDataFrame(made, "source string, lang string, topic string, probability double"))  # at most MAX_CELLS short rows


def _in_spark(cells: DataFrame, power: float, keep_share: float, targets: dict[str, dict] | None, rounds: int = 200, tolerance: float = 1e-9) -> DataFrame:
    """The same for any number of cells: each margin is one aggregation and one join, each round one table."""
    spark, store = cells.sparkSession, SharedTables(cells.sparkSession, "raking")
    now = store.write(cells.withColumn("weight", F.lit(1.0)), "weights_0")
    total = float(now.agg(F.sum("tokens")).first()[0] or 0)
    shares = {}
    for m in MARGINS:
        if targets and m in targets:
            rows = [(x, float(v)) for x, v in targets[m].items()]
            given = spark.createDataFrame(rows, "of string, raw double")
            raw = now.select(F.col(m).alias("value")).distinct().join(given, F.col("value").eqNullSafe(F.col("of")), "left").select("value", F.coalesce("raw", F.lit(0.0)).alias("raw"))
        else:
            raw = now.groupBy(F.col(m).alias("value")).agg(F.pow(F.sum("tokens") / F.lit(max(total, 1.0)), F.lit(power)).alias("raw"))
        raw = store.write(raw, f"raw_{m}")
        shares[m] = store.write(raw.withColumn("share", F.col("raw") / F.lit(max(float(raw.agg(F.sum("raw")).first()[0] or 0), 1e-300))), f"share_{m}")
    for step in range(1, rounds + 1):
        new, off = now, F.lit(0.0)
        for m in MARGINS:
            is_now = new.groupBy(F.col(m).alias("value")).agg(F.sum(F.col("tokens") * F.col("weight")).alias("is"))
            factor = is_now.join(shares[m].withColumnRenamed("value", "of"), F.col("value").eqNullSafe(F.col("of"))).select("value", F.when(F.col("is") > 0, F.col("share") * F.lit(total) / F.col("is")).otherwise(1.0).alias("factor"))
            new = new.join(factor, F.col(m).eqNullSafe(F.col("value"))).withColumn("weight", F.col("weight") * F.col("factor")).withColumn(f"off_{m}", F.abs(F.col("factor") - 1)).drop("value", "factor")
            off = F.greatest(off, F.col(f"off_{m}"))
        now = store.write(new.withColumn("off", off).select(*MARGINS, "tokens", "weight", "off"), f"weights_{step}")
        store.drop(f"weights_{step - 1}")
        worst, now = now.agg(F.max("off")).first()[0], now.drop("off")
        if worst is None or worst < tolerance:
            break
    if keep_share >= 1 or not total:
        return now.select(*MARGINS, F.lit(1.0).alias("probability"))
    goal, low, high = keep_share * total, 0.0, 1.0

    def expected(scales: list[float]) -> list[float]:
        return list(now.agg(*[F.sum(F.least(F.lit(1.0), F.lit(c) * F.col("weight")) * F.col("tokens")).alias(f"e{i}") for i, c in enumerate(scales)]).first())

    doubled = [2.0**i for i in range(60)]
    enough = [c for c, e in zip(doubled, expected(doubled), strict=True) if e >= goal]
    high = min(enough, default=doubled[-1])
    low = high / 2 if high > 1 else 0.0
    for _ in range(10):  # 32 places at a time
        scales = [low + (high - low) * i / 32 for i in range(1, 32)]
        below = [c for c, e in zip(scales, expected(scales), strict=True) if e < goal]
        low, high = max(below, default=low), min((c for c in scales if c not in below), default=high)
    return now.select(*MARGINS, F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.lit(high) * F.col("weight"))).otherwise(1.0).alias("probability"))


def uniform(doc_id: Column, seed: int) -> Column:
    """A number from 0 to 1 that depends on the id and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(doc_id.cast("string"), F.lit(seed)), 11) / F.lit(float(1 << 53))


def with_draw(docs: DataFrame, power: float, keep_share: float, seed: int, targets: dict[str, dict] | None = None, tokens: Callable[[list[bytes]], list[int]] = words_of, keep: tuple[str, ...] | None = None) -> DataFrame:
    """row (all columns of docs, or those to keep) and mix: n_tokens, topic, probability, kept."""
    bound_batches(docs.sparkSession)
    store = SharedTables(docs.sparkSession, "mixing")
    key = (F.col("source").cast("string"), F.col("lang").cast("string"), F.col("doc_id").cast("string"))
    # measured once; rounds read the hashed words alone, and a topic follows from them the same way each time
    rows = docs.select(F.struct(*(keep or ["*"])).alias("row"), measured("text", tokens).alias("of"), F.struct(*(k.alias(n) for k, n in zip(key, ("source", "lang", "id"), strict=True))).alias("by"))
    rows = store.write(rows, "rows")
    topic = topic_of(Topics.fit(rows.select("of.h", "of.at", "of.n"), store), "of.at", "of.n")
    rows = rows.select("row", "by", F.struct("of.n_tokens", topic.alias("topic")).alias("mix"))
    cells = store.write(rows.groupBy("by.source", "by.lang", "mix.topic").agg(F.sum("mix.n_tokens").alias("tokens")), "cells")
    p = probabilities(cells, power, keep_share, targets).toDF("p_source", "p_lang", "p_topic", "p")
    found = rows.join(p, F.col("by.source").eqNullSafe(F.col("p_source")) & F.col("by.lang").eqNullSafe(F.col("p_lang")) & (F.col("mix.topic") == F.col("p_topic")))
    return found.select("row", F.struct("mix.n_tokens", "mix.topic", F.col("p").alias("probability"), (uniform(F.col("by.id"), seed) < F.col("p")).alias("kept")).alias("mix"))


def mix(docs: DataFrame, power: float = 0.5, keep_share: float = 0.5, seed: int = 11, targets: dict[str, dict] | None = None, tokens: Callable[[list[bytes]], list[int]] = words_of) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, n_tokens, probability, kept."""
    found = with_draw(docs, power, keep_share, seed, targets, tokens, ("doc_id", "source", "lang"))
    return found.select("row.doc_id", "row.source", "row.lang", "mix.topic", "mix.n_tokens", "mix.probability", "mix.kept")
