"""Quality classifier from weak labels.

Simple labellers vote good, bad or abstain on every document. Expectation
maximisation over the counts of all vote patterns estimates how each labeller
votes on good and on bad documents, and from that the posterior of a pattern.
The posteriors then train a logistic scorer over hashed features (words, word
shapes, whether a word repeats the one before, and the votes), and the scorer decides.

Votes and pattern counts cover every document; there are at most 3^7 patterns,
so the estimation works on a small table. The scorer is fitted on a bounded
sample (``TRAIN_DOCS`` distinct texts at most, chosen by a hash, weighted by their counts). Documents
without a word (null, empty, blank) score 0 and are rejected; a null or repeated
doc_id is kept as it is. Repeated rows score alike, a score of exactly 0.5 is
kept, and very long texts count whole. With only one kind of documents the
scorer follows the posteriors, which then all lie on one side. Other columns,
whatever their names, are not read. An empty table gives an empty result.

The estimate of how often a labeller rejects a good document is held to
``FALSE_ALARMS`` at most: labellers overlap on documents of few kinds, and
without that bound the two classes may change places.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenlake.llm.common import id_text, map_batches, pieces, texts_of
from screenlake.llm.shingles import mix, word_hashes

BITS = 16
#: Distinct texts at most that the scorer is fitted on.
TRAIN_DOCS = 6000
GOOD, BAD, NONE = 1, 0, 2
#: A labeller rejects at most this share of good documents; keeps the estimate on the side of the precise labellers.
FALSE_ALARMS = 0.01
#: Words that the variety of a text is taken over.
BLOCK = 200
LABELLERS = ("repetition", "symbols", "capitals", "shouting", "wordless", "variety", "word_length")
_every = bytes(range(256))
SPACES = b" \t\n\x0b\x0c\r"
LETTERS = bytes(x for x in _every if x >= 0x80 or bytes([x]).isalpha())
#: Bytes that are no letter, digit, white space or plain punctuation.
SYMBOLS = bytes(x for x in _every if x not in LETTERS + SPACES + b"0123456789_.,;:'\"?!()-")
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
NO_LETTER = bytes(x for x in _every if x not in LETTERS + SPACES)
#: Shape of a word: capitals, letters and digits as one byte each.
SHAPES = bytes(1 if x in UPPER else 97 if x in LETTERS else 48 if x in b"0123456789" else x for x in _every)
VOTES = {(i, v): zlib.crc32(f"{name} {v}".encode()) & (1 << BITS) - 1 for i, name in enumerate(LABELLERS) for v in (GOOD, BAD)}
#: What a vote weighs beside the words of a text, which have length 1 together.
VOTE = 0.5
REPEATED = zlib.crc32(b"same") & (1 << BITS) - 1


def _band(x: float, good: float, bad: float) -> int:
    """Good up to one bound, bad from the other on, else no vote."""
    return GOOD if x <= good else BAD if x >= bad else NONE


def votes(text: bytes) -> tuple[int, ...]:
    """Votes of the labellers on one text, in the order of LABELLERS; nobody votes on a text without words."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return (NONE,) * len(LABELLERS)
    without = lambda x: len(text) - len(text.translate(None, x))
    upper, lower = without(UPPER), without(LOWER)
    mean = sum(map(len, words)) / n
    return (
        _band(sum(map(bytes.__eq__, words[1:], words)) / n, 0.02, 0.2) if n >= 8 else NONE,
        _band(without(SYMBOLS) / size, 0.01, 0.06),
        _band(upper / max(1, upper + lower), 0.3, 0.7) if upper + lower >= 20 else NONE,
        _band(text.count(b"!!") / n, 0.0, 0.2),
        _band(1 - len(text.translate(None, NO_LETTER).split()) / n, 0.1, 0.3),
        # by blocks, as a long text repeats more of its words
        _band(-sum(len(set(words[i : i + BLOCK])) for i in range(0, n, BLOCK)) / n, -0.3, -0.15) if n >= 50 else NONE,
        GOOD if 2 <= mean <= 15 else BAD if mean < 1.5 or mean > 40 else NONE,
    )


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """Share of good documents, P(vote | class, labeller), and the posterior of each pattern.

    A labeller that abstains says nothing. Labellers that reject are meant to be
    precise, so the start takes one bad vote for a bad document; every vote
    keeps a small pseudo-count.
    """
    post = np.where((patterns == BAD).any(1), 0.05, 0.95)
    onehot = np.stack([patterns == v for v in (BAD, GOOD)], 2)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - post), counts * post])
        prior = (weight[1].sum() + 1.9) / (counts.sum() + 2)  # where nothing tells them apart, 0.95 are good
        table = np.einsum("cp,plv->clv", weight, onehot) + 0.01
        table /= table.sum(2, keepdims=True)
        table[1, :, BAD] = np.minimum(table[1, :, BAD], FALSE_ALARMS)
        table[1, :, GOOD] = 1 - table[1, :, BAD]
        logs = np.einsum("plv,clv->pc", onehot, np.log(table)) + np.log([1 - prior, prior])
        new = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
        done = np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
    return prior, table, post


def features(text: bytes, cast: tuple[int, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a text with square roots of their counts, scaled to length 1, and of the votes cast on it."""
    words = word_hashes(text)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0)
    shape = np.frombuffer(text.translate(SHAPES), np.uint8)
    # of a byte that repeats, two stay
    more = np.ones(len(shape), bool)
    more[2:] = (shape[2:] != shape[1:-1]) | (shape[1:-1] != shape[:-2])
    shapes = mix(word_hashes(shape[more].tobytes()))
    ids = np.concatenate([words, shapes]) & np.uint64((1 << BITS) - 1)
    found, n = np.unique(np.append(ids.astype(np.int64), [REPEATED] * int((words[1:] == words[:-1]).sum())).astype(np.int64), return_counts=True)
    x = np.sqrt(n)
    cast = votes(text) if cast is None else cast
    own = [VOTES[i, v] for i, v in enumerate(cast) if v != NONE]
    return np.append(found, own).astype(np.int64), np.append(x / np.linalg.norm(x), [VOTE] * len(own))


def train(rows: list[tuple], l2: float = 1e-4, rounds: int = 600) -> np.ndarray:
    """Weights of a logistic model on rows of soft label, features, values and perhaps a count, the bias last; plain gradient steps with momentum."""
    if not rows:
        return np.zeros((1 << BITS) + 1)
    y = np.array([r[0] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    col, val = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows])
    used, col = np.unique(col, return_inverse=True)
    w, step, b = np.zeros(len(used)), np.zeros(len(used)), 0.0
    n = np.array([r[3] if len(r) > 3 else 1 for r in rows], float)
    total, good = n.sum(), (n * (y >= 0.5)).sum()
    # both classes weigh the same, if there are two
    each = n * np.where(y >= 0.5, total / (2 * good), total / (2 * (total - good))) if 0 < good < total else n
    for _ in range(rounds):
        z = np.bincount(row, val * w[col], len(rows)) + b
        g = (1 / (1 + np.exp(-z)) - y) * each / total
        step = 0.9 * step - 3.0 * (np.bincount(col, val * g[row], len(used)) + l2 * w)
        w += step
        b -= 1.0 * g.sum()
    out = np.zeros((1 << BITS) + 1)
    out[used], out[-1] = w, b
    return out


def _score(text: bytes, weights: np.ndarray, cast: tuple[int, ...] | None = None) -> float:
    i, x = features(text, cast)
    return float(1 / (1 + np.exp(-np.clip(weights[i] @ x + weights[-1], -500, 500)))) if len(i) else 0.0


class QualityModel:
    """Posterior of each vote pattern and the weights of the scorer."""

    def __init__(self, prior: float, accuracy: dict, posterior: dict[tuple, float], weights: np.ndarray):
        self.prior, self.accuracy, self.posterior, self.weights = prior, accuracy, posterior, weights

    @classmethod
    def fit(cls, docs: DataFrame, train_docs: int = TRAIN_DOCS) -> QualityModel:
        texts = id_text(docs)

        def vote(batch: pa.RecordBatch) -> dict:
            texts = texts_of(batch)
            return {"pattern": ["".join(map(str, votes(x))) for x in texts], "at": [zlib.crc32(x) for x in texts]}

        counted = map_batches(texts, vote, "pattern string, at long").groupBy("pattern").count().collect()  # 3^7 rows at most
        if not counted:
            return cls(0.5, {}, {}, np.zeros((1 << BITS) + 1))
        counted.sort(key=lambda r: r.pattern)
        patterns = np.array([[int(c) for c in r.pattern] for r in counted])
        counts = np.array([r["count"] for r in counted], float)
        prior, votes_by_class, post = estimate(patterns, counts)
        posterior = {tuple(p): float(x) for p, x in zip(patterns.tolist(), post, strict=True)}
        limit = int(2**32 * min(1.0, train_docs / counts.sum()))

        def sample(batch: pa.RecordBatch) -> dict:
            drawn = Counter(x for x in texts_of(batch) if zlib.crc32(x) < limit)
            out = []
            for x, n in drawn.items():
                if len((f := features(x, cast := votes(x)))[0]):
                    out.append((hashlib.sha256(x).digest(), n, posterior.get(cast, prior), f[0].astype("<i4").tobytes(), f[1].astype("<f4").tobytes()))
            return {k: [r[i] for r in out] for i, k in enumerate(("h", "n", "y", "i", "x"))}

        drawn = map_batches(texts, sample, "h binary, n long, y double, i binary, x binary")
        # one row a distinct text, and train_docs rows at most, however often a text repeats
        drawn = drawn.groupBy("h").agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in "yix"]).orderBy("h").limit(train_docs)
        rows = [(r.y, np.frombuffer(r.i, "<i4").astype(np.int64), np.frombuffer(r.x, "<f4").astype(float), r.n) for r in drawn.collect()]
        rows.sort(key=lambda r: (r[0], r[1].tobytes()))
        accuracy = {name: {"good": votes_by_class[1, i, GOOD], "bad": votes_by_class[0, i, BAD]} for i, name in enumerate(LABELLERS)}
        return cls(prior, accuracy, posterior, train(rows))

    def scorer(self, text: str) -> Column:
        """Score of a text column, 0 to 1, as a column."""
        weights = self.weights

        @F.arrow_udf("double")
        def score(texts: pa.Array) -> pa.Array:
            return pa.array([_score(x.as_py() or b"", weights) for x in texts.cast(pa.binary())], pa.float64())

        return score(F.col(f"`{text}`").cast("string"))

    def keep(self, docs: DataFrame, threshold: float = 0.5) -> DataFrame:
        """The rows of docs whose text scores threshold or more, with all their columns."""
        weights = self.weights

        def run(batches):
            for batch in pieces(batches):
                ok = [_score(x, weights) >= threshold for x in texts_of(batch)]
                yield batch.filter(pa.array(ok, pa.bool_()))

        return docs.mapInArrow(run, docs.schema)

    def transform(self, docs: DataFrame, threshold: float = 0.5) -> DataFrame:
        """doc_id, weak_posterior, score, kept."""
        weights, posterior, prior = self.weights, self.posterior, self.prior

        def one(batch: pa.RecordBatch) -> dict:
            texts = texts_of(batch)
            cast = [votes(x) for x in texts]
            scores = [_score(x, weights, v) for x, v in zip(texts, cast, strict=True)]
            return {"doc_id": batch.column(0), "weak_posterior": [posterior.get(v, prior) for v in cast], "score": scores, "kept": [x >= threshold for x in scores]}

        return map_batches(id_text(docs), one, "doc_id long, weak_posterior double, score double, kept boolean")
