"""The prefix trie against a brute-force version that holds all sequences."""

import hashlib
import random
import zlib

import pytest

from screenlake.llm import common
from screenlake.llm import prefix_trie as pt
from screenlake.llm.queries import shared_heads

SCHEMA = "conv_id long, turn long, role string, text string, n string, k1 string"


def brute(rows, heads):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            digest = lambda r, t: pt._halves(int.from_bytes(hashlib.sha256(len(r.encode()).to_bytes(8, "little") + r.encode() + t.encode()).digest()[:16], "big") % pt.P)
            own.setdefault(c, []).append(((turn is not None, turn or 0, digest(role or "", text or "")), (role or "", text or "")))
    own = {c: [x[1] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if heads else 0
        b = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = tuple((own.get(b, [])[:h] if h else []) + turns[h:])
    members = {}
    for c, s in built.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    out = []
    for k, m in members.items():
        under = [x for x in members if x[: len(k)] == k]
        parents = {x[:-1] for x in members if x}
        ends = sorted(c for c in m if len(built[c]) == len(k))
        out.append((
            min(m), len(k), min(members[k[:-1]]) if k else None, len(m), sum(1 for x in members if x and x[:-1] == k),
            sum(1 for x in under if x not in parents),
            sum((len(members[x]) - 1) * len(x[-1][1].encode().split()) for x in under if x),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def found(spark, rows, heads=True):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted((tuple(r) for r in (pt.prefix_trie(df, shared_heads, 3) if heads else pt.prefix_trie(df)).collect()), key=str)


def invented(seed, convs=60, most=9):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-40, 200), convs):
        for t in range(r.choice([1, 1, 2, 3, most])):
            rows.append((c, t, r.choice(["user", "bot"]) if t % 2 else "user", r.choice(["a b", "a  b\tc", "x", ""]), "x", "y"))
    return rows


@pytest.mark.parametrize("heads", [True, False])
@pytest.mark.parametrize("seed", [1, 2])
def test_nodes_match_brute_force(spark, seed, heads):
    rows = invented(seed)
    assert found(spark, rows, heads) == brute(rows, heads)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [
        (1, None, None, None, None, None), (1, 0, "user", "last"), (2, 3, "", ""), (2, 3, "", ""), (3, 3, "user", "b"), (3, 3, "user", "a"), (None, 1, "user", "gone"),
        (4, None, "", ""), (5, 0, None, "é " * 50_000), (6, 0, None, "é " * 50_000), (25, 1, "user", "only"),
    ]
    rows = [(*x, None, None)[:6] for x in rows]
    for heads in (True, False):
        assert found(spark, rows, heads) == brute(rows, heads)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_one_conversation_and_one_sequence_over_many_partitions(spark):
    """One conversation with a third of all turns, and one sequence with a third of all conversations."""
    rows = [(7, t, "user", f"turn {t}", "", "") for t in range(300)] + [(7 + 20 * i, t, "user", f"turn {t}", "", "") for i in range(1, 100) for t in range(3)]
    rows += [(1000 + i, 0, "user", "turn 0", "", "") for i in range(150)] + invented(5, 40)
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert df.repartitionByRange("conv_id", "turn").rdd.getNumPartitions() > 3
        for heads in (True, False):
            assert found(spark, rows, heads) == brute(rows, heads)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_of_keys_with_many_rows(spark, how):
    rows = spark.createDataFrame([(i, i % 50 if i % 3 else 0) for i in range(1000)] + [(-1, None)], "v long, k long")
    unique = spark.createDataFrame([(k, f"name {k}") for k in range(40)], "k long, name string")
    hot = common.lookup(rows, unique, ["k"], rows.groupBy("k").count().withColumnRenamed("count", "n"), 1001, how, share=10, least=0)
    plain = rows.join(unique, "k", how)
    assert sorted(hot.select("k", "v", "name").collect(), key=str) == sorted(plain.select("k", "v", "name").collect(), key=str)


def test_ends_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(pt, "BLOCK", 7)
    rows = [(i, 0, "user", "same", "", "") for i in range(100, 200)] + [(i, 0, "user", "other", "", "") for i in range(5)]
    assert found(spark, rows, False) == brute(rows, False)
