import pytest

import corpus_pipeline as P

from screenlake.llm import quality
from tests.llm.test_near_dedup import brute as near_brute
from tests.llm.test_quality_mixing import corpus
import random


@pytest.fixture
def docs(spark):
    rows = [(i, x, "en", f"s{i % 3}", len(x)) for i, x, _ in corpus(random.Random(10), 200)]
    rows += [(300, rows[0][1] + " ", "en", "s0", 1), (301, None, None, None, None), (302, rows[1][1] + " more", "en", "s1", 1), (None, rows[2][1], "de", "s1", 1), (3, *rows[3][1:]), (3, *rows[3][1:])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def key(x):
    return x.replace(" ", "")


def test_stages_against_plain_versions(spark, docs, tmp_path):
    now, before = docs, None
    for i, (name, stage) in enumerate(P.STAGES):
        rows = now.collect()
        out = stage(spark, now, "")
        out.write.parquet(f"{tmp_path}/{i}")
        now = spark.read.parquet(f"{tmp_path}/{i}")
        got = now.collect()
        if i < 4:
            assert now.columns == docs.columns
        if i == 0:
            model = quality.QualityModel.fit(docs)
            want = [r for r in rows if quality._score((r.text or "").encode(), model.weights) >= 0.5]
            assert sorted(map(repr, got)) == sorted(map(repr, want))
        elif i == 1:
            best = {}
            for r in rows:
                best.setdefault(key(r.text), []).append((-len(r.text), r.doc_id if r.doc_id is not None else 2**63, r))
            want = [min(x, key=lambda y: y[:2])[2] for x in best.values()]
            assert sorted(map(repr, got)) == sorted(map(repr, want))
        elif i == 2:
            kept = {d for d, _, c in near_brute([(r.doc_id, r.text) for r in rows]) if d == c}
            assert sorted(map(repr, got)) == sorted(repr(r) for r in rows if r.doc_id in kept)
        elif i == 3:
            assert 0 < len(got) <= len(rows) and {repr(r) for r in got} <= {repr(r) for r in rows}
        else:
            assert len(got) == len(rows) and all(len(r.ids) == r.n_tokens for r in got)


def test_empty_documents(spark, docs):
    now = docs.limit(0)
    for _, stage in P.STAGES:
        now = stage(spark, now, "")
    assert now.count() == 0


def test_stages_with_clashing_columns_nulls_and_a_long_text(spark, docs):
    """Helper columns have no name that a table could not have; every case has a defined row or none."""
    long_text = " ".join(f"this is sentence number {i} about the river and the house" for i in range(20_000))
    extra = spark.createDataFrame([(700, long_text, None, None, 1), (701, "", None, None, 0), (702, " \n", "en", "s0", 2)], docs.schema)
    now = docs.unionByName(extra).selectExpr("*", "1 AS row", "2 AS key", "3 AS mix", "4 AS by", "'x' AS kept", "5 AS score", "6 AS keep_id", "7 AS __sha")
    columns = now.columns
    stays = quality._score(long_text.encode(), quality.QualityModel.fit(now).weights) >= 0.5
    for i, (_, stage) in enumerate(P.STAGES):
        now = stage(spark, now, "")
        if i < 4:
            assert now.columns == columns
        if i in (0, 1, 2):
            kept = {r.doc_id for r in now.select("doc_id").collect()}
            assert (700 in kept) == stays and not {301, 701, 702} & kept  # texts without words go, a long one counts whole
    assert now.filter("doc_id = 700").count() <= 1


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    from types import SimpleNamespace

    import pytest as pt
    from screenlake.llm.common import SharedTables

    conf = SimpleNamespace(get=lambda *a: None)
    cluster = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077"), conf=conf)
    with pt.raises(ValueError, match="checkpoint"):
        SharedTables(cluster, "x")
    cluster.sparkContext.master = "local[4]"
    assert SharedTables(cluster, "x").root.startswith("file:")
