import numpy as np
from pyspark.sql import functions as F

from aislemetrics.llm import quality as Q
from aislemetrics.llm.common import crc_mod, table


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 6))
    y = (rng.random(4000) < 1 / (1 + np.exp(-3 * x[:, 0] * x[:, 1]))).astype(float)
    s = Q.train(x[:3000], y[:3000]).score(x[3000:])
    assert ((s > 0.5) == (y[3000:] > 0.5)).mean() > 0.72
    for low in (0.0, 0.3, 0.6):
        part = (s >= low) & (s < low + 0.3)
        assert abs(s[part].mean() - y[3000:][part].mean()) < 0.12


def test_one_class_and_no_rows():
    assert np.allclose(Q.train(np.zeros((0, 8)), np.zeros(0)).score(np.ones((2, 8))), 0.5)
    assert (Q.train(np.ones((5, 8)), np.ones(5)).score(np.ones((2, 8))) > 0.9).all()


def test_pool_is_the_mean_over_all_words(monkeypatch):
    monkeypatch.setattr(Q, "CACHE", 30_000)
    words = ["w%d" % i for i in range(50_000)]
    pool = Q.Pool({"w1": np.ones(Q.DIM, np.float32)})
    want = np.mean([Q.index_vector(w) + (w == "w1") for w in words], axis=0)
    assert np.allclose(pool(" ".join(words))[: Q.DIM], want, atol=1e-6)
    assert not pool(None).any() and not pool(" ").any()


def test_shape():
    assert Q.shape_of("SALE!!") == "X!" and Q.shape_of("Word,") == "Xx," and Q.shape_of("a1") == "x9"


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = Q.fit(docs, labels, crc_mod(F.col("id"), 4) != 2)
    scored = docs.withColumn("score", Q.quality_score(spark, model)("text"))
    rows = scored.join(labels, "doc_id").filter(crc_mod(F.col("doc_id"), 4) == 2).select("score", "quality").toPandas()
    good, bad = rows[rows.quality == 1].score, rows[rows.quality == 0].score
    assert (good >= 0.7).mean() > 0.99 and (bad < 0.7).mean() > 0.95
    assert rows.score.between(0, 1).all()


def test_null_empty_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "text here"), (1, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    model = Q.fit(docs, labels, F.lit(True))
    got = docs.withColumn("score", Q.quality_score(spark, model)("text")).collect()
    assert [round(r.score, 6) for r in got] == [0.5] * 4
    none = docs.limit(0)
    assert none.withColumn("score", Q.quality_score(spark, model)("text")).count() == 0


def test_long_tokens_count_whole():
    pool = Q.Pool({})
    start, piece = "ab1" * 21 + "c", "QQ--99zz" * 8
    got = pool(start + piece + "tail9")
    want = np.mean([Q.index_vector("\0" + Q.shape_of(t)) for t in (start, piece, "tail9")], axis=0)
    assert np.allclose(got[Q.DIM :], want, atol=1e-6)
    assert Q.shape_of("x" * 70 + "9") == "x9" and Q.tokens_of("a " + "b" * 130) == ["a", "b" * 64, "b" * 64, "bb"]
    assert not np.allclose(pool(start)[Q.DIM :], got[Q.DIM :])


def test_batches_without_words(spark):
    docs = spark.createDataFrame([(i, None if i % 2 else "") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    model = Q.fit(docs, labels, F.lit(True))
    assert len({r[0] for r in docs.select(Q.quality_score(spark, model)("text")).collect()}) == 1
