import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from agora.llm.common import read_table
from agora.llm.quality import FEATURES, Network, context_vectors, fit_network, fit_quality, fold, pool

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    model = fit_quality(docs, labels, train=fold(F.col("doc_id")) != 0)
    rows = model.score(docs).join(labels, "doc_id").where(fold(F.col("doc_id")) == 0).collect()
    assert len(rows) > 40
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_pooling_does_not_depend_on_the_batch(corpus):
    vectors = np.random.default_rng(0).normal(size=(8192, 32)).astype(np.float32)
    texts = [t for _, t in corpus]
    together = pool(pa.array(texts), vectors)
    for text, row in zip(texts, together):
        assert np.allclose(pool(pa.array([text]), vectors)[0], row, atol=1e-5)
    assert not together[texts.index("")].any()


def test_context_vectors_follow_neighbours(spark):
    texts = ["red apple pie", "red berry pie", "fast car race", "fast bike race"] * 5
    vectors = context_vectors(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    mean = lambda t: pool(pa.array([t]), vectors)[0, :32]
    near, far = mean("apple") @ mean("berry"), mean("apple") @ mean("car")
    assert near > 0.9 > far


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 6))
    truth = 1 / (1 + np.exp(-(x[:, 0] * x[:, 1] * 2 + x[:, 2])))
    y = (rng.random(4000) < truth).astype(float)
    net = fit_network(x, y)
    score = net.score(x)
    assert abs(score.mean() - y.mean()) < 0.03 and np.corrcoef(score, truth)[0, 1] > 0.85
    assert isinstance(net, Network) and 0.25 <= net.temperature <= 8


def test_edges(spark, edge_df, empty_df):
    labels = spark.createDataFrame([(4, 1, "x"), (7, 0, "x"), (7, 0, "x"), (None, 1, "x"), (2, None, "x"), (5, 1, "x")],
                                   "doc_id bigint, quality int, text string")
    model = fit_quality(edge_df, labels)
    rows = model.score(edge_df).collect()
    assert len(rows) == 13 and all(np.isfinite(r["score"]) for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2, 3)}) == 1
    assert model.score(empty_df).count() == 0
    none = fit_quality(edge_df, labels.limit(0))
    assert none.network.score(np.zeros((2, FEATURES))).tolist() == [0.5, 0.5]
    assert fit_quality(empty_df, labels).score(edge_df).count() == 13


def test_rows_for_fitting_are_bounded(spark, monkeypatch):
    from agora.llm import quality

    fitted = []
    monkeypatch.setattr(quality, "fit_network", lambda x, y: fitted.append(y.tolist()))
    rows = [(1, f"good text number {i}") for i in range(40)] + [(2, "bad ### text")] * 30 + [(3, "one more text")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1)] * 50 + [(2, 0)] * 9 + [(3, 1), (4, 1)], "doc_id bigint, quality int")
    fit_quality(docs, labels, max_labelled=10)
    fit_quality(docs, labels)
    assert len(fitted[0]) == 10 and sorted(fitted[1]) == [0.0] + [1.0] * 41


def test_a_row_without_an_id_is_in_no_fold(spark, tmp_path, edge_df):
    from agora.llm.queries import op8_quality

    edge_df.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = op8_quality(spark, str(tmp_path)).collect()
    assert {r["held_out"] for r in got} <= {True, False} and [r["held_out"] for r in got if r["doc_id"] is None] == [False]
