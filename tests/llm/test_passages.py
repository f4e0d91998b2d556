import random

from screenlake.llm import passages


def corpus(r):
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [r.choices(vocabulary, k=n) for n in (51, 70, 120)]
    rows, where = [], {}
    for i in range(60):
        words = r.choices(vocabulary, k=r.randint(5, 200))
        if i % 3:
            p = i % 2 + (i % 5 == 0)
            copy = list(base[p])
            for _ in range(r.choice([0, 0, 1, p]) if p else 0):
                copy[r.randrange(5, len(copy) - 5)] = "edited"
            at = r.randint(0, len(words))
            words[at:at] = copy
            where[i] = (at, at + len(copy), 22 if "edited" in copy else 0)
        rows.append((i, " ".join(words)))
    return rows, where


def test_planted_passages_are_found(spark):
    rows, where = corpus(random.Random(1))
    extra = [(100, None), (101, ""), (102, "few words"), (None, rows[1][1]), (103, "same " * 30_000), (104, rows[0][1])]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string").selectExpr("*", "1 AS seed", "2 AS spans").repartition(5)
    got = {x.doc_id: x for x in passages.Passages(docs).report().collect()}
    for i, (a, b, slack) in where.items():
        # an edit between an end and the first anchor cuts that end off
        assert any(s.start <= a + slack and s.end >= b - slack for s in got[i].spans), (i, a, b, got.get(i))
    long_clean = {i for i, x in rows if i not in where and (i != 0 or len(x.split()) < 50)}
    assert not set(got) & (long_clean | {100, 101, 102, None})


def test_identical_documents_and_empty_tables(spark):
    text = " ".join(f"a{i}" for i in range(80))
    docs = spark.createDataFrame([(1, text), (2, text), (3, text + " b"), (4, "other words")], "doc_id long, text string")
    got = {x.doc_id: (x.n_passages, x.n_words) for x in passages.Passages(docs).report().collect()}
    assert got == {1: (1, 80), 2: (1, 80), 3: (1, 80)}
    assert passages.Passages(docs.limit(0)).report().count() == 0


def test_fenwick_chain_is_the_best_chain():
    r = random.Random(2)
    for _ in range(200):
        n = r.randint(1, 9)
        pts = [(r.randint(0, 20), r.randint(0, 20)) for _ in range(n)]
        xs, ys = [p[0] for p in pts], [p[1] for p in pts]
        best = [6.0] * n
        for i in sorted(range(n), key=lambda i: pts[i]):
            for j in range(n):
                if xs[j] < xs[i] and ys[j] < ys[i]:
                    best[i] = max(best[i], best[j] + 6 - 0.1 * (xs[i] - xs[j] + ys[i] - ys[j]))
        first = passages.chain(xs, ys)[0]
        score = 6.0 + sum(6 - 0.1 * (xs[b] - xs[a] + ys[b] - ys[a]) for a, b in zip(first, first[1:]))
        assert abs(score - max(best)) < 1e-9
        assert all(xs[a] < xs[b] and ys[a] < ys[b] for a, b in zip(first, first[1:]))


def test_edit_distance():
    assert passages.edit_distance([1, 2, 3], [1, 3]) == 1
    assert passages.edit_distance([1, 2, 3, 4], [1, 9, 3, 5]) == 2
    assert passages.edit_distance([], [1, 2]) == 2


def test_chain_takes_the_best_predecessor_within_the_gap():
    r = random.Random(3)
    for _ in range(300):
        n, gap = r.randint(1, 40), r.choice([3, 8, 20])
        pts = sorted({(r.randint(0, 80), r.randint(0, 80)) for _ in range(n)})
        best = [6.0] * len(pts)
        for i, (x, y) in enumerate(pts):
            for j, (p, q) in enumerate(pts[:i]):
                if 0 < x - p <= gap + 6 and 0 < y - q <= gap + 6:
                    best[i] = max(best[i], best[j] + 6 - 0.1 * (x - p + y - q))
        first = [pts[i] for i in passages.chain([p[0] for p in pts], [p[1] for p in pts], max_gap=gap)[0]]
        score = 6.0 + sum(6 - 0.1 * (b[0] - a[0] + b[1] - a[1]) for a, b in zip(first, first[1:]))
        assert abs(score - max(best)) < 1e-9
        assert all(0 < b[0] - a[0] <= gap + 6 and 0 < b[1] - a[1] <= gap + 6 for a, b in zip(first, first[1:]))


def test_two_passages_of_the_same_texts(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, where = [], {}
    for n, apart in enumerate((60, 100, 200)):
        one, two = r.choices(vocabulary, k=120), r.choices(vocabulary, k=60)
        for i in (2 * n, 2 * n + 1):
            rows.append((i, " ".join([*one, *r.choices(vocabulary, k=apart), *two])))
            where[i] = [(0, 120), (120 + apart, 180 + apart)]
    got = {x.doc_id: x for x in passages.Passages(spark.createDataFrame(rows, "doc_id long, text string")).report().collect()}
    assert {i: [(s.start, s.end) for s in got[i].spans] for i in where} == where


def planted(r, vocabulary, passage, before, after):
    return " ".join([*r.choices(vocabulary, k=before), *passage, *r.choices(vocabulary, k=after)])


def test_partial_copies_do_not_hide_a_passage(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows, where = [], {}
    for n in range(12):
        passage = r.choices(vocabulary, k=60)
        # two texts share all of it, others only the first or the last 40 words, or both
        parts = {1: passage[:40], 2: passage[20:], 5: passage, 7: passage[:40], 8: passage[20:], 9: passage}
        for i in [i for i in parts if n % 3 == 0 or i in (5, 9) or (n % 3 == 1) == (i in (1, 7))]:
            before = r.randint(0, 60)
            rows.append((10 * n + i, planted(r, vocabulary, parts[i], before, r.randint(0, 60))))
            if i in (5, 9):
                where[10 * n + i] = [(before, before + 60)]
    got = {x.doc_id: [(s.start, s.end) for s in x.spans] for x in passages.Passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).report().collect()}
    assert got == where


def test_edited_short_passages_are_found_whole(spark):
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(20_000)]
    rows, where = [], {}
    for n in range(60):
        passage = r.choices(vocabulary, k=r.randint(51, 80))
        copy, size = list(passage), len(passage)
        # one edit or two that leave 37 equal words, or one that leaves 21 on both sides
        edits = [(r.randrange(5, size - 37),), (r.randrange(21, size - 21),), (r.randrange(5, 10), size - r.randrange(6, 10)) if size > 56 else (5,)][n % 3]
        for at in edits:
            copy[at] = "edited"
        for i, words in ((2 * n, passage), (2 * n + 1, copy)):
            before = r.randint(0, 40)
            rows.append((i, planted(r, vocabulary, words, before, r.randint(0, 40))))
            where[i] = (before, before + size)
    got = {x.doc_id: [(s.start, s.end) for s in x.spans] for x in passages.Passages(spark.createDataFrame(rows, "doc_id long, text string")).report().collect()}
    for i, (a, b) in where.items():
        assert any(s <= a and e >= b for s, e in got.get(i, [])), (i, a, b, got.get(i))


def test_a_chain_of_low_identity_is_cut_and_not_dropped():
    r = random.Random(7)
    one, two = bytes(r.choices(range(100), k=55)), bytes(r.choices(range(100), k=6))
    a, b = one + bytes(range(100, 140)) + two, one + bytes(range(140, 180)) + two
    assert [x[:4] for x in passages.align(a, b, [0, 20, 49, 95], [0, 20, 49, 95], 50, 0.8)] == [(0, 55, 0, 55)]


def test_matches_in_line_are_one_chain():
    import numpy as np

    r = random.Random(21)
    for _ in range(300):
        x = sorted(r.sample(range(400), r.randint(2, 12)))
        shift = r.randint(-5, 50)
        y = [v + shift + (r.random() < 0.1) for v in x]
        if passages.in_line(np.array(x), np.array(y), np.array([0]))[0]:
            assert passages.chain(x, y) == [list(range(len(x)))]
    assert passages.in_line(np.array([1, 9, 5, 40]), np.array([2, 10, 1, 36]), np.array([0, 2])).tolist() == [True, False]


def test_ends_grow_side_by_side_as_one_by_one():
    """The ends of all chains of a batch are aligned together, cell for cell as alone."""
    r, pairs = random.Random(31), []
    for _ in range(2000):
        a = [r.randrange(r.choice([4, 30, 256])) for _ in range(r.choice([0, 1, 3, 20, 64]))]
        b = [w if r.random() > 0.1 else r.randrange(256) for w in a if r.random() > 0.08] if r.random() < 0.6 else [r.randrange(30) for _ in range(r.choice([0, 1, 64]))]
        pairs.append((bytes(a), bytes(b)))
    assert passages.extend_all(pairs) == [tuple(passages.extend(a, b)) for a, b in pairs]
    assert passages.extend_all([]) == []
    a, b = bytes(range(100)), bytes(range(50)) + bytes([7]) + bytes(range(51, 100))
    xs = ys = [20, 60]
    ends = passages.extend_all(passages.beside(a, b, 20, 20, 60 + passages.K, 60 + passages.K))
    assert passages.align(a, b, xs, ys, 50, 0.8, outer=ends) == passages.align(a, b, xs, ys, 50, 0.8) == [(0, 100, 0, 100, 0.99)]


def test_a_passage_with_one_shared_seed_is_found(spark):
    r = random.Random(41)
    vocabulary = [f"w{i}" for i in range(20_000)]
    rows, where = [], {}
    while len(where) < 60:
        passage = r.choices(vocabulary, k=r.randint(51, 70))
        copy, n = list(passage), len(where)
        for at in range(6, len(copy) - 6, 7):  # six equal words from edit to edit
            copy[at] = "edited"
        made = [(r.randint(0, 40), words) for words in (passage, copy)]
        texts = [planted(r, vocabulary, words, before, r.randint(0, 40)) for before, words in made]
        one, two = (set(passages.seeds(text.encode())[1].tolist()) for text in texts)
        if len(one & two) == 1:
            for i, text, (before, words) in zip((n, n + 1), texts, made, strict=True):
                rows.append((i, text))
                where[i] = (before, before + len(words))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: ([(s.start, s.end) for s in x.spans], x.rep_ids) for x in passages.Passages(docs).report().collect()}
    for i, (a, b) in where.items():
        spans, others = got.get(i, ([], []))
        assert any(s <= a and e >= b for s, e in spans) and (i % 2 == 0 or others == [i - 1]), (i, a, b, spans, others)


def test_every_match_is_in_one_chain(spark):
    rows, _ = corpus(random.Random(42))
    rows += [(100, "same " * 5000), (101, " ".join(f"a{i % 30} a{i % 7}" for i in range(3000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    matches = sorted(tuple(x) for x in passages.Passages(docs).matches().distinct().collect())
    chained = [(x.doc_id, i, x.rep_id, j) for x in passages.Passages(docs).chains().collect() for i, j in zip(x.xs, x.ys, strict=True)]
    assert sorted(chained) == matches


def test_one_id_with_texts_of_different_length(spark):
    r = random.Random(43)
    vocabulary = [f"w{i}" for i in range(5000)]
    passage = r.choices(vocabulary, k=60)
    # the words of the short text end before the passage of the long one
    rows = [(1, "few words"), (1, planted(r, vocabulary, passage, 300, 10)), (2, planted(r, vocabulary, passage, 20, 20))]
    got = {x.doc_id: [(s.start, s.end) for s in x.spans] for x in passages.Passages(spark.createDataFrame(rows, "doc_id long, text string")).report().collect()}
    assert got == {1: [(300, 360)], 2: [(20, 80)]}
