import hashlib
import random
from collections import Counter

import pytest

from screenlake.llm import repeats


def brute(texts, least):
    count = Counter(x[i : i + least] for x in texts for i in range(len(x) - least + 1))
    out = []
    for x in texts:
        gone = bytearray(len(x))
        for i in range(len(x) - least + 1):
            if count[x[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        kept = bytes(c for c, g in zip(x, gone, strict=True) if not g)
        out.append((len(x), sum(gone), sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(r):
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7)))
    passages = [" ".join(word() for _ in range(n)) for n in (20, 40, 60, 90)]
    texts = ["x" * 250, "x" * 199, "x" * 200, "ab" * 300, None, "", "short"]
    for _ in range(70):
        parts = [" ".join(word() for _ in range(r.randint(1, 40)))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, len(p) // 3)
            parts += [p[a : len(p) - r.randint(0, len(p) // 3)], " ".join(word() for _ in range(r.randint(0, 30)))]
        texts.append(" ".join(parts))
    return [*texts, texts[10], texts[11], texts[11], texts[12] + "y"]


@pytest.mark.parametrize(("seed", "hot"), [(1, 256), (2, 3)])
def test_matches_brute_force(spark, seed, hot):
    texts = corpus(random.Random(seed))
    rows = [(i if i != 20 else None, x) for i, x in enumerate(texts)] + [(9, texts[30])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_bytes", "2 AS t1").repartition(6)
    got = sorted(((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in repeats.Repeats(docs, hot=hot).removed().collect()), key=repr)
    want = brute([(x or "").encode() for _, x in rows], 200)
    assert got == sorted(((i, *w) for (i, _), w in zip(rows, want, strict=True)), key=repr)


def test_empty_table(spark):
    assert repeats.Repeats(spark.createDataFrame([], "doc_id long, text string")).removed().count() == 0


def test_anchors_of_long_texts_do_not_depend_on_blocks(monkeypatch):
    r = random.Random(3)
    text = bytes(r.choice(b"abcd ") for _ in range(20_000))
    whole = repeats.anchors(text)
    monkeypatch.setattr(repeats, "STEP", 700)
    assert all((a == b).all() for a, b in zip(whole, repeats.anchors(text), strict=True))


def test_maximal_repeats_have_all_occurrences():
    r = random.Random(4)
    for _ in range(200):
        n = r.randint(2, 9)
        lefts = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 6))) for _ in range(n)]
        rights = [b"#" + bytes(r.choice(b"ab") for _ in range(r.randint(0, 6))) for _ in range(n)]
        for members, left, right in repeats.maximal_repeats(lefts, rights, 4):
            same = [m for m in range(n) if len(lefts[m]) >= left and len(rights[m]) >= right and lefts[m][:left] == lefts[members[0]][:left] and rights[m][:right] == rights[members[0]][:right]]
            assert sorted(members) == same and len(same) > 1
        best = {m: max([a + b for ms, a, b in repeats.maximal_repeats(lefts, rights, 4) if m in ms], default=0) for m in range(n)}
        for m in range(n):
            want = max(repeats.common(lefts[m], lefts[k]) + repeats.common(rights[m], rights[k]) for k in range(n) if k != m)
            assert best[m] == (want if want >= 4 else 0)


def test_a_window_with_its_smallest_gram_twice_is_no_repeat(spark):
    """One long periodic text and texts that share a gram only: with every gram hot, nothing else goes than with none."""
    import random

    rng = random.Random(5)
    unit = "".join(rng.choice("abcdefgh ") for _ in range(90))
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    texts = [noise(150) + unit * 2 + noise(150) for _ in range(6)] + [unit * 5, noise(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cold, hot = (sorted(map(tuple, repeats.Repeats(docs, hot=h).removed().collect())) for h in (256, 1))
    assert cold == hot
    assert {r[0]: r[2] for r in cold} == {i: len(texts[i]) if i == 6 else 0 for i in range(8)}


def test_split_groups_name_the_same_repeats(spark):
    """Not merged, hot grams give occurrences whose bytes are equal under one name, and the same union as the scan of whole groups."""
    rng = random.Random(11)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passage = noise(260)
    texts = [noise(120) + passage[: 200 + 5 * i] + noise(120) for i in range(12)] + [noise(100) + passage[40 - i :] + noise(90) for i in range(8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by_key = {repeats.text_key(t.encode()): t.encode() for t in texts}
    unions = []
    for hot in (256, 2):
        rows = repeats.Repeats(docs, hot=hot).occurrences().collect()
        names, gone = {}, {k: bytearray(len(t)) for k, t in by_key.items()}
        for r in rows:
            text = by_key[r.t1, r.t2]
            gone[r.t1, r.t2][r.start : r.end] = b"\1" * (r.end - r.start)
            if r.repeat is not None:
                names.setdefault(r.repeat, set()).add(text[r.start : r.end])
                assert r.end - r.start >= 200
        assert names and all(len(x) == 1 for x in names.values())
        unions.append(gone)
    assert unions[0] == unions[1]
