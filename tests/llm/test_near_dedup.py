import random
import re

import numpy as np
import pytest

from screenlake.llm import near_dedup, shingles


def brute_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, brute_set(x)) for i, x in rows]
    for n, (i, s) in enumerate(sets):
        for j, t in sets[:n]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= 75 * len(s | t):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return sorted(((i, len(s), None if i is None else find(i) if s else find(i)) for i, s in sets), key=repr)


def corpus(r, groups):
    vocabulary = [f"w{i}" for i in range(400)]
    passage = r.choices(vocabulary, k=60)
    rows, n = [], 0
    for _ in range(groups):
        base = r.choices(vocabulary, k=r.choice([3, 8, 40, 120]))
        if r.random() < 0.5:
            base = base + passage
        for _ in range(r.choice([1, 1, 2, 6])):
            text = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                text[r.randrange(len(text))] = r.choice(vocabulary)
            rows.append((n, r.choice([" ", "\n", "  "]).join(text).replace("w1", r.choice(["w1", "W1"]))))
            n += 1
    return rows


@pytest.mark.parametrize(("seed", "bucket", "groups"), [(1, 256, 40), (2, 6, 12)])
def test_components_match_brute_force(spark, seed, bucket, groups):
    rows = corpus(random.Random(seed), groups)
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE  two"), (905, "x " * 30_000), (906, "x " * 40_000), (None, rows[0][1]), (5, rows[5][1]), (7, rows[9][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS component_id", "2 AS sig").repartition(7)
    got = near_dedup.near_dedup(docs, bucket=bucket).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=repr) == brute(rows)
    assert all(x.kept == (x.doc_id == x.component_id) for x in got)


def test_empty_table(spark):
    assert near_dedup.near_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pigeonhole_guarantee():
    r = np.random.default_rng(3)
    for _ in range(200):
        a = r.integers(0, 2**16, shingles.SYMBOLS).astype(np.uint16)
        b = a.copy()
        b[r.choice(shingles.SYMBOLS, 31, replace=False)] ^= np.uint16(1 + r.integers(0, 1000))
        ka, kb = near_dedup.chunk_keys(np.stack([a, b]))
        assert (ka == kb).any()


def test_long_texts_hash_alike_in_blocks(monkeypatch):
    text = b" ".join(b"word%d" % (i % 97) for i in range(3000))
    whole = shingles.word_hashes(text)
    monkeypatch.setattr(shingles, "BLOCK", 1000)
    assert (shingles.word_hashes(text) == whole).all()


def test_met_keeps_runs_across_batches():
    import pyarrow as pa

    keys = [1, 2, 2, 3, 4, 4, 4, 5, 6, 6, 7]
    for size in (1, 2, 3, 5, 11):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + size], pa.int64()), pa.array(range(i, min(len(keys), i + size)), pa.int64())], names=["key", "class_id"]) for i in range(0, len(keys), size)]
        out = [x for b in near_dedup._met(iter(batches)) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert out == [(1, 0, 0), (2, 1, 1), (2, 2, 1), (4, 4, 4), (4, 5, 4), (4, 6, 4), (6, 8, 8), (6, 9, 8), (7, 10, 10)], size


def family(r, n, own, base):
    """n texts of which a share of the words in a row is their own."""
    return [" ".join([*base, *(f"v{r.random()}" for _ in range(own))]) for _ in range(n)]


def test_a_hot_family_leaves_no_large_bucket(spark):
    """Texts that share most words but not enough: every signature key is hot, and the prefixes of the sets are not."""
    r = random.Random(8)
    base = [f"b{i}" for i in range(84)]
    texts = family(r, 300, 20, base)
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)] + [(1000, texts[7] + " more"), (1001, texts[9] + " words")], "doc_id long, text string").repartition(5)
    job = near_dedup.NearDedup(docs, bucket=16)
    job.store.drop = lambda *names: None
    out = {x.doc_id: x.component_id for x in job.run().collect()}
    assert {i: c for i, c in out.items() if i != c} == {1000: 7, 1001: 9}
    texts = spark.read.parquet(f"{job.store.root}/texts")
    wanted = texts.selectExpr("class_id", "class_id AS comp")
    job.store = near_dedup.SharedTables(spark, "prefixes")
    sizes = [x["count"] for x in job._prefixes(wanted, texts).groupBy("key").count().collect()]
    assert max(sizes, default=0) <= 16


@pytest.mark.parametrize("bucket", [4, 1000])
def test_links_inside_a_hot_family_are_exact(spark, bucket):
    r = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    texts = [x for n in (12, 16, 20, 24) for x in family(r, 12, n, base)]
    texts += [" ".join(x.split()[:-k]) for x, k in zip(texts, range(1, 30), strict=False)]
    rows = list(enumerate(texts))
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), bucket=bucket).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=repr) == brute(rows)
