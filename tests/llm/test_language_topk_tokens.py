import random

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from screenlake.llm import language_id, token_counts, topk

WORDS = {"en": "the and with that have this from they were which".split(), "de": "der und mit dass haben diese nicht sich werden über".split(), "ru": "это как его только быть может если уже или ни".split()}


def test_held_out_accuracy(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choices(WORDS[x], k=r.randint(5, 40))), x) for i in range(400) for x in [r.choice(sorted(WORDS))]]
    rows += [(1000, None, "en"), (1001, "", "de"), (1002, "123 !!", None), (1003, "und " * 50_000, None), (None, "the that", "en"), (5, rows[5][1], rows[5][2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    out = language_id.language_id(docs, dim=512).collect()
    assert len(out) == len(rows) and all(0 <= x.score <= 1 for x in out)
    lang = {i: x for i, _, x in rows[:400]}
    held = [x for x in out if x.held_out and x.doc_id in lang]
    assert len(held) > 50 and np.mean([x.lang_pred == lang[x.doc_id] for x in held]) > 0.97
    by = {x.doc_id: x for x in out}
    assert [by[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "de"]


def test_language_id_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language_id.language_id(docs).count() == 0
    one = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language_id.language_id(one).collect()[0].lang_pred == "und"


def test_bundle_equals_plain_sum():
    s = language_id.Space(64)
    (got,) = s.bundle(["Ab c1ba".encode()])
    want = sum(np.roll(s.letter(a), 2).astype(int) * np.roll(s.letter(b), 1) * s.letter(c) for a, b, c in [(0, 97, 98), (97, 98, 0), (0, 99, 0), (0, 98, 97), (98, 97, 0)])
    assert (got == want).all()


def test_exact_top_k(spark):
    r = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in np.round(r.normal(size=6), 1)], 0) for i in range(700)]
    rows += [(700, None, 0), (750, [None] + [0.0] * 5, 0), (800, [float("nan")] * 6, 0), (850, [0.0] * 6, 0), (900, [1.0, 2.0], 0), (None, [0.0] * 6, 0), (3, rows[3][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score long").repartition(5)
    got = {}
    for x in topk.exact_top_k(df, lambda i: i % 50 == 0, candidates=100, queries=5).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    good = [(i, np.floor(256 * np.array(v))) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    for q, v in good:
        if q % 50 == 0:
            best = sorted((-int(v @ w), i) for i, w in good if i != q and len(w) == len(v))[:5]
            assert sorted(got.get(q, [])) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert set(got) == {i for i in range(0, 700, 50)} | {850}
    assert topk.exact_top_k(df.limit(0), lambda i: i % 50 == 0).count() == 0


def greedy(word, pieces):
    n, word = 0, token_counts.MARK + word
    while word:
        for k in range(len(word), 0, -1):
            if word[:k] in pieces:
                n, word = n + 1, word[k:]
                break
        else:
            n, word = n + len(word[0].encode()), word[1:]
    return n


def test_automaton_equals_greedy():
    r = random.Random(5)
    for _ in range(60):
        pieces = {"".join(r.choices("abc▁é", k=r.randint(1, 5))) for _ in range(r.randint(1, 25))}
        a = token_counts.Automaton(sorted(pieces))
        for _ in range(60):
            w = "".join(r.choices("abcéz", k=r.randint(0, 14)))
            assert a.count(w) == greedy(w, pieces), (pieces, w)


def test_token_counts(spark):
    model = P.path("piece_bpe_32k.model")
    texts = ["Hello world", None, "", "  \n", "x" * 3000, "naïve 東京 z 🙂", "Hello world"]
    docs = spark.createDataFrame([(i, x, 1) for i, x in enumerate(texts)], "doc_id long, text string, n_tokens int")
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces = {m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))}
    got = {x.doc_id: (x.n_words, x.n_tokens) for x in token_counts.token_counts(docs, model).collect()}
    for i, x in enumerate(texts):
        words = [w.decode() for w in (x or "").encode().split()]
        assert got[i] == (len(words), sum(greedy(w, pieces) for w in words))


def test_held_out_accuracy_and_plain_cosines(spark):
    """On a real table: accuracy on rows outside the sample, and every prediction by plain vectors."""
    import numpy as np

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {x.doc_id: x for x in language_id.language_id(docs).collect()}
    lang = {x.doc_id: x.lang for x in docs.collect()}
    held = [i for i, x in rows.items() if x.held_out and lang[i] is not None]
    assert len(held) > 200 and np.mean([rows[i].lang_pred == lang[i] for i in held]) > 0.98
    profiles = language_id.fit(docs.selectExpr("*", "false AS held_out").filter("crc32(cast(doc_id AS string)) % 4 <> 2"))
    space = language_id.Space(language_id.DIM)
    for x in docs.limit(40).collect():
        letters = [c.lower() if len(c.lower()) == 1 else c for c in f" {x.text} "]
        total = np.zeros(language_id.DIM)
        code = [ord(c) if c.isalpha() else 0 for c in letters]
        for i in range(1, len(code) - 1):
            if code[i]:
                total += np.roll(space.letter(code[i - 1]), 2) * np.roll(space.letter(code[i]), 1).astype(int) * space.letter(code[i + 1])
        cos = {k: total @ v / np.linalg.norm(total) / np.linalg.norm(v) for k, v in profiles.items()}
        best = max(cos, key=cos.get)
        assert rows[x.doc_id].lang_pred == best and abs(rows[x.doc_id].score - max(0, cos[best])) < 1e-9


def test_ties_go_to_the_first_language_and_copies_agree(spark):
    docs = spark.createDataFrame([(1, "abc abd", "x"), (2, "abc abd", "a"), (2, "abc abd", "a"), (None, "abc abd", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id.language_id(docs).collect()} == {"a"}


def test_blocks_below_the_kth_score_are_skipped(spark):
    """Vectors about a few directions: most blocks are never asked, and the result is that of all pairs."""
    r = np.random.default_rng(5)
    ways = r.normal(size=(12, 16))
    rows = [(i, [float(np.float32(x)) for x in ways[i % 12] + r.normal(size=16) * 0.05]) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    search = topk.Search(df, lambda i: i % 20 == 0, 5, 256, "vec_id", "embedding", 50, 16)
    home = search.at_home()
    blocks, queries = search.rows.select("block").distinct().count(), search.asked.count()
    asked = search.left_over(home).count()
    assert blocks >= 24 and asked < 0.3 * queries * (blocks - 1)
    got = {(x.query_id, x["rank"]): (x.vec_id, x.score) for x in topk.exact_top_k(df, lambda i: i % 20 == 0, candidates=50, queries=16).collect()}
    whole = {i: np.floor(256 * np.array(v)) for i, v in rows}
    for q in range(0, 1200, 20):
        best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]


def test_words_are_read_side_by_side_as_one_by_one(monkeypatch):
    """Whole texts at once give the counts of single words; only words with rare characters and very long ones are read alone."""
    path, r = P.path("piece_bpe_32k.model"), random.Random(21)
    texts = [b"", b" \n", b"\xff\xfe a\xc3 b\xe2\x82 c", "a\u2581b \u2581 \u65e5\u672c\u8a9e \u0442\u0435\u0441\u0442".encode(), b"x" * 70 + b" " + b"y" * 64 + b" " + b"z" * 65, b"\x00 \x1c\x1d a\x0bb\x0cc"]
    texts += ["".join(r.choices("abcdefghi\u00e9 \u00fc\u2581\u65e5 \n\t.,0123456789\u00df\U0001f600", k=r.randint(0, 200))).encode() for _ in range(300)]
    automaton, _ = token_counts.load(path)
    want = [(len(ws), sum(automaton.count(w.decode("utf-8", "replace")) for w in ws)) for ws in (x.split() for x in texts)]
    for group in (token_counts.GROUP, 50, 1):
        monkeypatch.setattr(token_counts, "GROUP", group)
        assert list(zip(*token_counts.counter(path)(texts), strict=True)) == want
    monkeypatch.setattr(token_counts.Automaton, "count", lambda self, word: pytest.fail(f"{word} was read alone"))
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz,.019AZ", k=r.randint(1, 20))) for _ in range(500)]
    assert token_counts.counter(path)([" ".join(words).encode()])[0] == [500]
