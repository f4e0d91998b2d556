"""The merge of sorted digest runs against a plain version."""

import random

import numpy as np
import pytest

from screenlake.llm import exact_dedup


def brute(rows):
    groups = {}
    for i, x in rows:
        groups.setdefault("".join(c for c in x or "" if c not in " \t\n\x0b\x0c\r"), []).append((-len(x or ""), i is None, i or 0, i))
    best = {k: (min(v)[3], -min(v)[0], len(v)) for k, v in groups.items()}
    out = []
    for i, x in rows:
        keep, size, n = best["".join(c for c in x or "" if c not in " \t\n\x0b\x0c\r")]
        out.append((i, keep, n, i == keep and len(x or "") == size))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("fan_in", "parts", "block"), [(2, 7, 3), (3, 10, 4096), (2, 1, 2)])
def test_runs_merge_to_the_best_rows(spark, monkeypatch, fan_in, parts, block):
    monkeypatch.setattr(exact_dedup, "BLOCK", block)
    r = random.Random(fan_in)
    rows = [(i, r.choice(["a b", "ab", "a  b", "é x", "éx ", None, "", " ", f"own {i}"])) for i in range(300)]
    rows += [(2**63 - 1, "the last id"), (2**63 - 1, "last"), (None, "the  last id"), (None, "alone"), (None, "two"), (None, "two"), (-(2**63), "first"), (3, *rows[3][1:]), (900, "long " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS digest", "2 AS n_chars", "3 AS run").repartition(parts)
    got = sorted(((x.doc_id, x.keep_id, x.group_size, x.kept) for x in exact_dedup.exact_dedup(docs, fan_in).collect()), key=repr)
    assert got == brute(rows)


def test_two_sorted_arrays_become_one():
    r = np.random.default_rng(1)
    for _ in range(50):
        parts = []
        for _ in range(2):
            x = np.zeros(r.integers(0, 9), exact_dedup.ROW)
            x["key"], x["n"] = np.sort(r.integers(65, 70, len(x)).astype(np.uint8)).view("S1"), 1
            parts.append(x)
        one = exact_dedup.merge(*parts)
        assert (one["key"] == np.sort(np.concatenate([p["key"] for p in parts]))).all()
        assert exact_dedup.collapse(one)["n"].sum() == len(one)
