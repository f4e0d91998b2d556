import random

import numpy as np

from screenlake.llm import mixing, quality
from screenlake.llm.common import SharedTables

CLEAN = "this is a short sentence about how the river runs from north to south near my house every single day".split()


def corpus(r, n):
    rows = []
    for i in range(n):
        words = r.choices(CLEAN, k=r.randint(20, 60))
        kind = r.choice(["good"] * 6 + ["symbols", "repeat", "shout"])
        text = {"good": " ".join(words), "symbols": "### ".join(words) + "%%%", "repeat": " ".join([words[0]] * 60), "shout": "!! ".join(words).upper()}[kind]
        rows.append((i, text, kind))
    return rows


def test_junk_goes_and_clean_stays(spark):
    rows = corpus(random.Random(6), 500)
    extra = [(1000, None, ""), (1001, "", ""), (1002, "long sentence here " * 20_000, ""), (None, rows[0][1], ""), (0, rows[0][1], "")]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, score string")
    model = quality.QualityModel.fit(docs)
    out = {}
    for x in model.transform(docs).collect():
        out.setdefault(x.doc_id, []).append(x)
    kind = {i: k for i, _, k in rows}
    assert np.mean([out[i][0].kept == (kind[i] == "good") for i in kind]) > 0.98
    assert not out[1000][0].kept and out[1001][0].score == 0 and len(out[0]) == 2 and out[0][0] == out[0][1]
    column = {x.doc_id: x.s for x in docs.select("doc_id", model.scorer("text").alias("s")).collect()}
    assert all(abs(column[i] - out[i][0].score) < 1e-12 for i in kind)


def test_quality_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert quality.QualityModel.fit(docs).transform(docs).count() == 0


def test_estimate_recovers_accuracies():
    r = np.random.default_rng(7)
    good = r.random(20_000) < 0.8
    votes = np.stack([np.where(r.random(20_000) < np.where(good, 0.995, a), 1, 0) for a in (0.3, 0.4, 0.2)], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, table, _ = quality.estimate(patterns, counts)
    assert abs(prior - 0.8) < 0.03 and np.allclose(table[0, :, quality.GOOD], [0.3, 0.4, 0.2], atol=0.06)


def test_raking_meets_all_margins():
    r = np.random.default_rng(8)
    shape = (4, 3, 2)
    tokens = r.integers(1, 1000, shape).astype(float).ravel()
    indexes = [x.ravel() for x in np.indices(shape)]
    targets = [r.dirichlet(np.ones(n)) for n in shape]
    w = mixing.rake(tokens, indexes, targets)
    for i, t in zip(indexes, targets, strict=True):
        assert np.allclose(np.bincount(i, tokens * w) / (tokens * w).sum(), t)
    p = mixing.calibrate(tokens, w, 0.3)
    assert p.max() <= 1 and np.isclose((p * tokens).sum(), 0.3 * tokens.sum())


def test_mix_draws_by_probability(spark):
    r = random.Random(9)
    rows = [(i, " ".join(r.choices(["alphabet", "borough", "chair", "dictionary"], k=r.randint(0, 30))), r.choice(["a", "b", None]), r.choice(["x", "y"])) for i in range(4000)]
    rows += [(None, None, None, None), (5000, "word " * 50_000, "a", "x"), (3, *rows[3][1:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").selectExpr("*", "1 AS topic", "2 AS probability")
    out = mixing.mix(docs, keep_share=0.6).collect()
    assert len(out) == len(rows)
    by = {}
    for x in out:
        by.setdefault((x.source, x.lang, x.topic), []).append(x)
    for xs in by.values():
        assert len({x.probability for x in xs}) == 1
        if len(xs) > 150:
            assert abs(np.mean([x.kept for x in xs]) - xs[0].probability) < 0.15
    assert {x.topic for x in out} <= {"none", *(f"topic{i}" for i in range(8))}
    assert {x.kept for x in out if x.doc_id == 3} in ({True}, {False})
    assert mixing.mix(docs.limit(0)).count() == 0


def test_training_sample_is_bounded_when_a_text_repeats(spark, monkeypatch):
    import zlib

    limit = 2**32 * 20 / 700
    hot = next(x for i in range(10_000) if zlib.crc32((x := f"a hot text number {i}").encode()) < limit)
    rows = [(i, hot if i < 300 else f"some other words {i}") for i in range(700)]
    seen = []
    monkeypatch.setattr(quality, "train", lambda rows: seen.append(rows) or np.zeros((1 << quality.BITS) + 1))
    quality.QualityModel.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), train_docs=20)
    assert 0 < len(seen[0]) <= 20 and max(r[3] for r in seen[0]) == 300


def test_cells_beyond_the_driver_are_raked_alike(spark, monkeypatch):
    r = random.Random(12)
    rows = [(f"s{i % 7}" if i % 7 else None, f"l{i % 3}", f"topic{i % 5}", float(r.randint(0, 900))) for i in range(105)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens double")
    targets = {"source": {"s1": 0.3, "s2": 0.3, "s3": 0.1, "s4": 0.1, "s5": 0.1, "s6": 0.05, None: 0.05}}
    for given in (None, targets):
        here = {tuple(x)[:3]: x.probability for x in mixing.probabilities(cells, 0.5, 0.4, given).collect()}
        monkeypatch.setattr(mixing, "MAX_CELLS", 10)
        there = {tuple(x)[:3]: x.probability for x in mixing.probabilities(cells, 0.5, 0.4, given).collect()}
        monkeypatch.undo()
        assert here.keys() == there.keys() and all(abs(here[k] - there[k]) < 1e-5 for k in here)


def test_draws_match_a_plain_version(spark):
    """Probabilities by plain dictionaries, and the draw of each document by its own hash."""
    r = random.Random(13)
    rows = [(i, " ".join(r.choices(["alphabet", "borough", "chair", "dictionary", "elm"], k=r.randint(1, 30))), r.choice(["a", "b"]), r.choice(["x", "y"])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out = mixing.mix(docs, power=0.5, keep_share=0.6, seed=3).collect()
    tokens = {}
    for x in out:
        assert x.n_tokens == len(rows[x.doc_id][1].split())
        k = (x.source, x.lang, x.topic)
        tokens[k] = tokens.get(k, 0) + x.n_tokens
    weight, total = dict.fromkeys(tokens, 1.0), sum(tokens.values())
    targets = []
    for m in range(3):
        share = {}
        for k, n in tokens.items():
            share[k[m]] = share.get(k[m], 0) + n
        share = {v: (n / total) ** 0.5 for v, n in share.items()}
        targets.append({v: x / sum(share.values()) for v, x in share.items()})
    for _ in range(500):
        for m in range(3):
            now = {}
            for k, n in tokens.items():
                now[k[m]] = now.get(k[m], 0) + n * weight[k]
            weight = {k: w * targets[m][k[m]] * total / now[k[m]] for k, w in weight.items()}
    low, high = 0.0, 1e6
    for _ in range(200):
        c = (low + high) / 2
        low, high = (c, high) if sum(min(1, c * weight[k]) * n for k, n in tokens.items()) < 0.6 * total else (low, c)
    u = {x.doc_id: x.u for x in docs.select("doc_id", mixing.uniform(docs.doc_id, 3).alias("u")).collect()}
    for x in out:
        p = min(1, high * weight[x.source, x.lang, x.topic])
        assert abs(x.probability - p) < 1e-6 and (abs(u[x.doc_id] - p) < 1e-6 or x.kept == (u[x.doc_id] < p))


def test_scores_match_a_plain_version_and_the_labels(spark):
    """Every score of a real table by the plain formula, and the decisions against the labels."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = quality.QualityModel.fit(docs)
    out = {x.doc_id: x for x in model.transform(docs).collect()}
    for x in docs.collect():
        at, value = quality.features((x.text or "").encode())
        want = 1 / (1 + np.exp(-(sum(model.weights[i] * v for i, v in zip(at, value, strict=True)) + model.weights[-1]))) if len(at) else 0
        assert abs(out[x.doc_id].score - want) < 1e-9
    labels = spark.read.parquet(f"{d}/labels.parquet").collect()
    assert np.mean([out[x.doc_id].kept == (x.quality == 1) for x in labels]) > 0.99


def test_one_kind_only_and_ties(spark):
    good = spark.createDataFrame([(i, t) for i, t, k in corpus(random.Random(3), 200) if k == "good"], "doc_id long, text string")
    assert quality.QualityModel.fit(good).transform(good).filter("NOT kept").count() == 0
    empty = quality.QualityModel(0.5, {}, {}, np.zeros((1 << quality.BITS) + 1))
    assert [x.kept for x in empty.transform(good.limit(3)).collect()] == [True] * 3  # exactly 0.5 stays


def hashed(spark, texts):
    return spark.createDataFrame([(x,) for x in texts], "text string").select(mixing.measured("text").alias("of")).select("of.h", "of.at", "of.n")


def test_topics_are_fitted_on_all_documents(spark):
    r = random.Random(8)
    texts = [" ".join(r.choices([f"t{i % 3}w{j}" for j in range(40)] + [f"c{j}" for j in range(30)], k=30)) for i in range(2600)]
    topics = mixing.Topics.fit(hashed(spark, texts + [None, ""]).repartition(5), SharedTables(spark, "topics"))
    # the weight of a word that no document has
    assert round(float(np.exp(topics.rare.max()))) == 2601
    again = mixing.Topics.fit(hashed(spark, texts[::-1]).repartition(3), SharedTables(spark, "topics"))
    assert (topics.rare == again.rare).all() and np.abs(topics.centroids - again.centroids).max() < 1e-4
    # the centroids are at right angles to the main directions by plain numpy, or nearly so
    x = np.zeros((len(texts), mixing.DIM))
    for i, text in enumerate(texts):
        at, value = mixing.hashed_words(text.encode())
        x[i, at] = value * topics.rare[at]
    x /= np.linalg.norm(x, axis=1)[:, None]
    main = np.linalg.svd(x, full_matrices=False)[2][:3].T  # three vocabularies: the fourth direction is noise
    assert np.abs(topics.centroids @ main).max() < 0.05


def test_few_words_are_held_at_once_and_all_are_measured(spark, monkeypatch):
    """A worker's memory follows from the texts that it cuts at once, so a batch goes by in pieces."""
    texts = [None, "", *(f"one two w{i} w{i % 7}" for i in range(50)), "long " * 40]

    def tokens(given):
        assert len(given) == 1 or sum(map(len, given)) <= 100
        return mixing.words_of(given)

    monkeypatch.setattr(mixing, "PIECE", 100)
    docs = spark.createDataFrame([(x,) for x in texts], "text string").coalesce(1)
    out = [x.of for x in docs.select(mixing.measured("text", tokens).alias("of")).collect()]
    assert [x.n_tokens for x in out] == [len((x or "").split()) for x in texts]
    assert [(bytes(x.at), bytes(x.n)) for x in out] == [(at.astype("<u2").tobytes(), n.astype("<f4").tobytes()) for at, n in (mixing.hashed_words((x or "").encode()) for x in texts)]


def test_first_rows_are_those_of_the_whole_table(spark):
    rows = [(i % 40, bytes([i % 3]), b"n") for i in range(400)]
    vectors = spark.createDataFrame(rows, "h long, at binary, n binary").repartition(6)
    out = vectors.mapInArrow(mixing._first(8), vectors.schema).distinct().orderBy("h", "at", "n").limit(8).collect()
    assert [(x.h, bytes(x.at), bytes(x.n)) for x in out] == sorted(set(rows))[:8]


def test_main_directions_take_few_rounds():
    """Each round reads all documents, so directions with close values must not take a round for every small turn."""
    r = np.random.default_rng(4)
    turned = np.linalg.qr(r.normal(size=(300, 300)))[0]
    value = np.concatenate([[900.0, 120, 80, 40, 32, 31, 30, 29, 28], np.full(291, 1.0)])
    rounds = []

    def times(y):
        rounds.append(y.shape)
        return (turned * value) @ (turned.T @ y)

    main = mixing.principal(r.normal(size=(300, 8)), times)
    assert len(rounds) <= 6 and main.shape == (300, 4)
    assert np.linalg.norm(main - turned[:, :4] @ (turned[:, :4].T @ main)) < 1e-3
    one = np.outer(turned[:, 0], turned[:, 0])
    assert np.abs(mixing.principal(turned[:, :1], lambda y: one @ y)[:, 0] @ turned[:, 0]) > 0.999


def test_a_word_of_a_chunk_takes_two_bytes_and_no_count_is_lost():
    """Rounds read what was hashed, with counts beyond MANY, at a quarter of the bytes."""
    import pyarrow as pa

    texts = [b"", b"a b c b", b"word " * 5000 + b"a", *(b" ".join(b"w%d" % (i * j % 97) for j in range(200)) for i in range(300))]
    vectors = [mixing.hashed_words(x) for x in texts]
    batch = pa.RecordBatch.from_arrays([pa.array([x.astype(t).tobytes() for x in column], pa.binary()) for column, t in zip(zip(*vectors), ("<u2", "<f4"))], names=["at", "n"])
    rare = np.linspace(0.5, 3, mixing.DIM).astype(np.float32)
    chunks = list(mixing._packed(rare)([batch]))
    assert sum(c.num_rows for c in chunks) == 3 and sum(len(c["codes"][0].as_py()) for c in chunks) == 2 * sum(len(at) for at, _ in vectors)
    rows = [x * scale[:, None] for c in chunks for x, scale in mixing._dense(c, mixing._weights(rare), rare)]
    found = np.concatenate(rows)
    for (at, n), row in zip(vectors, found, strict=True):
        want = np.zeros(mixing.DIM)
        want[at] = n * rare[at]
        assert np.allclose(row, want / max(np.linalg.norm(want), 1e-9), atol=1e-6)
