import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from screenlake.llm import bpe
from screenlake.llm.exact_dedup import exact_dedup

RANKS = P.path("byte_bpe_50k.tiktoken")
ODD = ["", None, " ", "\n\n  \tx", "I'll don't", "naïve ß Straße 東京都 🙂👨‍👩‍👧", "a" * 5000, "<|endoftext|>", "\x00\x01", "ab" * 700, "١٢٣ ½ ²", "  two  spaces  ", " x y　z"]


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_tiktoken(reference):
    r = random.Random(1)
    texts = [x or "" for x in ODD] + ["".join(r.choice("abcde  \n'lsé9.,🙂") for _ in range(r.randint(1, 200))) for _ in range(400)]
    got = bpe.load(RANKS, P.PATTERN).encode_batch(texts)
    assert [x.tolist() for x in got] == [reference.encode_ordinary(x) for x in texts]


def test_round_trip_and_parts(spark, reference):
    rows = [(i, x, "extra") for i, x in enumerate(ODD)] + [(None, "no id", "extra"), (3, "again", "extra")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.round_trip(docs, RANKS, P.PATTERN).collect()
    assert len(out) == len(rows) and all(x.exact for x in out)
    assert sorted(x.decoded_sha256 for x in out) == sorted(hashlib.sha256((x[1] or "").encode()).hexdigest() for x in rows)
    ids = bpe.encode(docs, RANKS, P.PATTERN)
    back = {x.doc_id: x.text for x in bpe.decode(ids, RANKS, P.PATTERN).collect() if x.doc_id is not None and x.doc_id != 3}
    assert all(back[i] == (x or "") for i, x in enumerate(ODD) if i != 3)
    assert all(x.offsets == sorted(x.offsets) and len(x.ids) == len(x.offsets) for x in ids.collect())
    assert bpe.round_trip(docs.limit(0), RANKS, P.PATTERN).count() == 0


def test_split_characters():
    b = bpe.load(RANKS, P.PATTERN)
    (ids,) = b.encode_batch(["🙂"])
    assert len(ids) > 1 and b.decode(ids[:1]) == "�" and b.decode(ids) == "🙂"


def brute(rows):
    groups = {}
    for i, x in rows:
        groups.setdefault("".join(c for c in x or "" if c not in " \t\n\x0b\x0c\r"), []).append((-len(x or ""), i if i is not None else 2**63, i))
    return sorted(((i, min(groups[k])[2], len(groups[k])) for i, x in rows for k in ["".join(c for c in x or "" if c not in " \t\n\x0b\x0c\r")]), key=repr)


@pytest.mark.parametrize("fan_in", [2, 16])
def test_exact_dedup_matches_brute_force(spark, fan_in):
    r = random.Random(2)
    rows = [(i, r.choice([None, "", " ", "a b", "ab", " a\tb", "x y", "é" * r.randint(1, 3), "long " * 3000])) for i in range(300)] + [(None, "ab"), (None, "only"), (7, "dup id"), (7, "dup id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS digest", "2 AS kept").repartition(9)
    got = exact_dedup(docs, fan_in).collect()
    assert sorted(((x.doc_id, x.keep_id, x.group_size) for x in got), key=repr) == brute(rows)
    assert {x.text_sha256 for x in got} == {x.text_sha256 for x in got if x.kept}


def test_exact_dedup_empty(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_decoding_reverses_the_byte_characters():
    one = bpe.load(RANKS, P.PATTERN)
    assert "".join(chr(x) for x in sorted(one.byte_of)) == "".join(sorted(bpe.byte_characters()))
    texts = [x or "" for x in ODD]
    for x, ids in zip(texts, one.encode_batch(texts)):
        assert one.decode_bytes(ids) == x.encode()
        assert one.offsets(ids)[-1] == len(x.encode())
