"""Byte-level BPE encoding and decoding with the tokenizers library.

The ranks file gives vocabulary and merges: every way to make a token from two
shorter tokens is a merge, in order of the rank of what it makes, and a match
that is a token itself is taken whole. Bytes travel as the characters that
byte-level tokenizers use for them.

Matches of the pattern repeat a lot, so each Arrow batch is split once, every
distinct match is encoded once by the library, and ids and byte offsets of the
texts are put together from those. Null texts count as empty; an empty text has
no ids. Texts of any length are encoded whole. A null or repeated doc_id is kept
as it is, and repeated rows encode alike. Other columns, whatever their names,
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from screenlake.llm.common import id_text, map_batches

#: Distinct matches that a worker keeps between batches.
CACHED = 100_000


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class ByteBPE:
    """A tokenizer from a ranks file, one for each worker process."""

    def __init__(self, ranks_path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core already
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        chars = byte_characters()
        spell = lambda x: "".join(map(chars.__getitem__, x))
        merges = [(spell(t[:i]), spell(t[i:])) for t in sorted(ranks, key=ranks.get) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.table: list[str] = [""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.table[i] = spell(token)
        self.lengths = np.array([len(x) for x in self.table], np.int64)
        self.byte_of = {ord(c): b for b, c in enumerate(chars)}
        self.tokenizer = Tokenizer(models.BPE(vocab={spell(t): i for t, i in ranks.items()}, merges=merges, ignore_merges=True, cache_capacity=0))
        # every input is one match already; the byte-level step only maps its bytes to characters
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > CACHED:
            self.known.clear()
        known = self.known
        split = [self.split(x) for x in texts]
        new = list({w for ws in split for w in ws if w not in known})
        if new:
            for w, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
                known[w] = np.array(e.ids, "<u4").tobytes()
        get = known.__getitem__
        return [np.frombuffer(b"".join(map(get, ws)), "<u4") for ws in split]

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte at which each token starts, and the end."""
        return np.concatenate([[0], np.cumsum(self.lengths[ids])])

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Bytes of ids, by the reversed table of byte characters."""
        return "".join(map(self.table.__getitem__, ids.tolist())).translate(self.byte_of).encode("latin-1")

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; bytes of a character that the ids cut in two become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(2)
def load(ranks_path: str, pattern: str) -> ByteBPE:
    return ByteBPE(ranks_path, pattern)


def _strings(batch: pa.RecordBatch) -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index("text")).to_pylist()]


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids, offsets (byte at which each token starts)."""

    def one(batch):
        bpe = load(ranks_path, pattern)
        ids = bpe.encode_batch(_strings(batch))
        return {"doc_id": batch.column(0), "ids": [x.astype("i4") for x in ids], "offsets": [bpe.offsets(x)[:-1] for x in ids]}

    return map_batches(id_text(docs), one, "doc_id long, ids array<int>, offsets array<long>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, bytes, text; a null list of ids gives null."""

    def one(batch):
        bpe = load(ranks_path, pattern)
        data = [None if x is None else bpe.decode_bytes(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "bytes": data, "text": [None if x is None else x.decode("utf-8", "replace") for x in data]}

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                made = one(batch.slice(i, 256))
                yield pa.RecordBatch.from_arrays([pa.array(made["doc_id"], pa.int64()), pa.array(made["bytes"], pa.binary()), pa.array(made["text"], pa.string())], names=["doc_id", "bytes", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary, text string")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, exact (decoding gives the text again and the offsets end where it ends), and ids if asked for.

    Encodes and decodes in one pass, so the ids need not leave the task.
    """

    def one(batch):
        bpe, texts = load(ranks_path, pattern), _strings(batch)
        ids = bpe.encode_batch(texts)
        back = [bpe.decode_bytes(x) for x in ids]
        return {
            "doc_id": batch.column(0),
            "n_tokens": [len(x) for x in ids],
            "ids_sha256": [hashlib.sha256(x.tobytes()).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in back],
            "exact": [x == y.encode() and int(bpe.offsets(i)[-1]) == len(x) for x, y, i in zip(back, texts, ids, strict=True)],
            "ids": [x.astype("i4") for x in ids] if with_ids else None,
        }

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean" + ", ids array<int>" * with_ids
    return map_batches(id_text(docs), one, schema, 2_000_000)
