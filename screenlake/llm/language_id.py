"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter n-gram of three
(inside words, with the word boundary as a letter of its own) is bound into one
vector by multiplying the vectors of its letters, each rotated by its place.
A text is the bundle (sum) of its n-gram vectors, a language the bundle of its
unit text vectors, and the language with the largest cosine is predicted.

Texts that are null or have no letter are ``und`` with score 0; so is every
text if nothing was learned. Ties go to the first language in order. Whole
texts count, of any length. Sums are of whole numbers, so results do not depend
on how rows are dealt. Repeated rows and rows with a null doc_id count each; the
sample is drawn by a hash of id and text. Columns beside doc_id, text and lang,
whatever their names, are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlake.llm.common import map_batches, texts_of

DIM = 1024
UNKNOWN = "und"
#: Labelled texts for each language that the profiles are fitted on, about.
TRAIN_DOCS = 2000
SCALE = 1 << 20


@lru_cache(1)
def letters() -> np.ndarray:
    """Lower-case letter of each code point, 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


class Space:
    """Random letter vectors, made from their code points when first needed."""

    def __init__(self, dim: int, seed: int = 7):
        self.dim, self.seed, self.known = dim, seed, {}

    def letter(self, c: int) -> np.ndarray:
        if c not in self.known:
            bits = np.random.Generator(np.random.Philox(key=[self.seed, c])).integers(0, 2, self.dim, np.int8)
            self.known[c] = bits * np.int8(2) - np.int8(1)
        return self.known[c]

    def bind(self, symbols: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Vectors of n-grams; a, b and c are places in symbols."""
        base = np.stack([self.letter(int(x)) for x in symbols])
        return np.roll(base, 2, 1)[a] * np.roll(base, 1, 1)[b] * base[c]

    def bundle(self, texts: list[bytes]) -> np.ndarray:
        """Sum of n-gram vectors of each text, as float64 of whole numbers."""
        text = "\n".join(["", *(x.decode("utf-8", "replace").replace("\n", " ") for x in texts), ""])
        raw = np.frombuffer(text.encode("utf-32-le"), "<u4")
        doc = np.cumsum(raw == 10) - 1
        sym = letters()[raw]
        at = np.flatnonzero(sym)
        out = np.zeros((len(texts), self.dim))
        if not len(at):
            return out
        symbols = np.flatnonzero(np.bincount(sym, minlength=1))
        lut = np.zeros(int(symbols[-1]) + 1, np.int64)
        lut[symbols] = np.arange(len(symbols))
        small = lut[sym]
        n = len(symbols)
        keys = (small[at - 1] * n + small[at]) * n + small[at + 1]
        if n**3 <= 1 << 24:
            grams = np.flatnonzero(np.bincount(keys, minlength=1))
            dense = np.zeros(n**3, np.int64)
            dense[grams] = np.arange(len(grams))
            keys = dense[keys]
        else:
            grams, keys = np.unique(keys, return_inverse=True)
        doc = doc[at]
        # blocks of n-grams and of texts keep the tables small
        for g in range(0, len(grams), 8192):
            block = grams[g : g + 8192]
            vectors = self.bind(symbols, block // (n * n), block // n % n, block % n).astype(np.float32)
            step = max(1, 4_000_000 // len(block))
            inside = slice(None) if len(grams) <= 8192 else (keys >= g) & (keys < g + 8192)
            k, d = keys[inside] - g, doc[inside]
            for t in range(0, len(texts), step):
                lo, hi = np.searchsorted(d, [t, t + step])
                if lo < hi:
                    m = min(step, len(texts) - t)
                    counts = np.bincount((d[lo:hi] - t) * len(block) + k[lo:hi], minlength=m * len(block)).reshape(m, -1)
                    exact = np.float32 if hi - lo < 1 << 24 else np.float64
                    out[t : t + m] += counts.astype(exact) @ vectors.astype(exact, copy=False)
        return out


@lru_cache(2)
def space(dim: int) -> Space:
    return Space(dim)


def fit(docs: DataFrame, dim: int = DIM, train_docs: int = TRAIN_DOCS) -> dict[str, np.ndarray]:
    """Language prototypes from doc_id, text and lang; rows without a language don't count.

    About train_docs texts of each language are taken, by a hash of doc_id and text.
    """
    known = docs.filter("lang IS NOT NULL").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    # one number a language: a label set, not data
    share = [F.lit(x) for r in known.groupBy("lang").count().collect() for x in (r.lang, float(train_docs * SCALE / r["count"]))]
    if not share:
        return {}
    picked = known.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SCALE)) < F.create_map(*share)[F.col("lang")])

    def partial(batch: pa.RecordBatch) -> dict:
        vectors = space(dim).bundle(texts_of(batch))
        norm = np.linalg.norm(vectors, axis=1)
        unit = np.rint(vectors / np.maximum(norm, 1)[:, None] * SCALE).astype(np.int64)
        langs = np.array(batch.column(2).to_pylist())
        found = sorted(set(langs.tolist()))
        return {"lang": found, "total": [unit[langs == x].sum(0) for x in found]}

    # every partition adds up its own, and dim numbers a language come back
    sums = map_batches(picked.select("doc_id", "text", "lang"), partial, "lang string, total array<long>", 16_000_000)
    sums = sums.select("lang", F.posexplode("total").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    totals: dict[str, np.ndarray] = {}
    for row in sums.collect():
        totals.setdefault(row.lang, np.zeros(dim))[row.i] = row.x
    return {x: totals[x] for x in sorted(totals) if np.any(totals[x])}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], dim: int = DIM) -> DataFrame:
    """doc_id, held_out, lang_pred, score (cosine, negative as 0); docs needs doc_id, text and held_out."""
    names = list(profiles)
    unit = np.stack([profiles[x] / np.linalg.norm(profiles[x]) for x in names]) if names else np.zeros((0, dim))

    def one(batch: pa.RecordBatch) -> dict:
        vectors = space(dim).bundle(texts_of(batch))
        norm = np.linalg.norm(vectors, axis=1)
        cos = vectors @ unit.T / np.maximum(norm, 1)[:, None]
        any_letter = (norm > 0) & bool(names)
        best = cos.argmax(1) if names else np.zeros(len(norm), int)
        return {
            "doc_id": batch.column(0),
            "held_out": batch.column(2),
            "lang_pred": [names[b] if ok else UNKNOWN for b, ok in zip(best, any_letter, strict=True)],
            "score": [min(1.0, max(0.0, float(cos[i, b]))) if ok else 0.0 for i, (b, ok) in enumerate(zip(best, any_letter, strict=True))],
        }

    return map_batches(docs.select("doc_id", "text", "held_out"), one, "doc_id long, held_out boolean, lang_pred string, score double")


def language_id(docs: DataFrame, dim: int = DIM, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Fit on the rows that are not held out and predict all rows.

    Held out: crc32 of doc_id as text has the remainder 2 after division by 4
    (a null doc_id is not held out). A prediction sees the text alone.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.col("lang"),
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"),
    )
    return predict(rows, fit(rows.filter("NOT held_out"), dim, train_docs), dim)
