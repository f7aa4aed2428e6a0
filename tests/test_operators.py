import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from agora.operators.binning import bin_by_edges, equal_width_histogram, qcut
from agora.operators.quantiles import quantiles_by_rank, quantiles_percentile
from agora.operators.ranking import global_rank, ntile_cuts, tile_of
from agora.operators.reshape import reindex, with_share


def skewed(spark, n=3000):
    rng = np.random.default_rng(7)
    # a third of all rows share one key value (hot key)
    key = np.where(rng.random(n) < 0.34, 5, rng.integers(0, 200, n))
    pdf = pd.DataFrame({"id": np.arange(n)[rng.permutation(n)], "k": key.astype("int64"),
                        "v": rng.normal(100, 30, n).round(2)})
    return spark.createDataFrame(pdf), pdf


def test_global_rank_total_order_with_hot_key(spark):
    df, pdf = skewed(spark)
    got = global_rank(df, [F.desc("k"), F.asc("id")], "r", "n", partitions=7).toPandas()
    expect = pdf.sort_values(["k", "id"], ascending=[False, True]).reset_index(drop=True)
    expect["r"] = np.arange(len(expect))
    merged = got.merge(expect[["id", "r"]], on="id", suffixes=("", "_exp"))
    assert len(merged) == len(pdf)
    assert (merged["r"] == merged["r_exp"]).all()
    assert (got["n"] == len(pdf)).all()


@pytest.mark.parametrize("n_rows", [3000, 4, 13])
def test_global_ntile_matches_window_ntile(spark, n_rows):
    df, _ = skewed(spark, n_rows)
    got = df.select("id", tile_of(F.col("k"), F.col("id"), ntile_cuts(df, F.col("k"), "id", 5)).alias("t"))
    ref = df.withColumn("t_ref", F.ntile(5).over(Window.orderBy("k", "id")))
    joined = got.join(ref, "id")
    assert joined.where(F.col("t") != F.col("t_ref")).count() == 0
    assert joined.count() == n_rows


def test_exact_quantiles_match_numpy(spark):
    df, pdf = skewed(spark)
    probs = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]
    one = spark.range(1)
    by_rank = one.select(quantiles_by_rank(df, "v", probs, "id")).first()[0]
    by_map = one.select(quantiles_percentile(df, "v", probs)).first()[0]
    expect = np.quantile(pdf["v"].to_numpy(), probs)
    assert np.allclose(by_rank, expect, rtol=0, atol=1e-9)
    assert np.allclose(by_map, expect, rtol=0, atol=1e-9)


def test_qcut_and_cut_match_pandas(spark):
    df, pdf = skewed(spark)
    probs = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]
    edges = quantiles_percentile(df, "v", probs)
    got = df.select("id", qcut(F.col("v"), edges, [5, 4, 3, 2, 1]).alias("q"),
                    bin_by_edges(F.col("k").cast("double"), [0, 1, 2, 3, 5, float("inf")],
                                 [1, 2, 3, 4, 5]).alias("c")).toPandas()
    pdf = pdf.assign(q=pd.qcut(pdf["v"], 5, labels=[5, 4, 3, 2, 1]).astype(int),
                     c=pd.cut(pdf["k"], [0, 1, 2, 3, 5, np.inf], labels=[1, 2, 3, 4, 5]))
    m = got.merge(pdf, on="id", suffixes=("", "_pd"))
    assert (m["q"] == m["q_pd"]).all()
    c_pd = m["c_pd"].astype("float")
    assert ((m["c"].astype("float") == c_pd) | (m["c"].isna() & c_pd.isna())).all()


def test_qcut_duplicate_edges_raise(spark):
    df = spark.createDataFrame([(1.0,)] * 10 + [(2.0,)], "v double")
    edges = quantiles_percentile(df, "v", [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])
    with pytest.raises(Exception, match="unique"):
        df.select(qcut(F.col("v"), edges, [1, 2, 3, 4, 5])).collect()
    with pytest.raises(ValueError):
        pd.qcut(pd.Series([1.0] * 10 + [2.0]), 5)


@pytest.mark.parametrize("values", [
    [1, 2, 2, 3, 7, 9, 9, 9, 15, 40],
    [0.1, 0.7, 0.3, 2.9, 2.9, 1.0000001],
    [4, 4, 4],
])
def test_histogram_matches_numpy(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = equal_width_histogram(df, "x", 50).orderBy("bin").toPandas()
    counts, edges = np.histogram(np.array(values, dtype=float), bins=50)
    assert len(got) == 50
    assert got["n"].tolist() == counts.tolist()
    assert np.allclose(got["lower"], edges[:-1], rtol=0, atol=1e-12)
    assert np.allclose(got["upper"], edges[1:], rtol=0, atol=1e-12)


def test_share_and_reindex(spark):
    df = spark.createDataFrame([("x", None, 1), ("y", None, None), ("y", "z", 3)],
                               "k string, s string, n int")
    counts = df.groupBy("k").count()
    shares = dict((r.k, r.share_pct) for r in with_share(counts, "count").collect())
    assert shares["y"] == pytest.approx(200 / 3)
    full = reindex(counts, "k", ["x", "y", "w"]).orderBy("_order").collect()
    assert [(r.k, r["count"]) for r in full] == [("x", 1), ("y", 2), ("w", None)]


def test_ntile_cuts_equal_the_window(spark):
    rows = [(i, None if i % 17 == 0 else (i * 7) % 13 if i % 3 else 5) for i in range(101)]
    for n in (101, 7, 3, 1, 0):
        df = spark.createDataFrame(rows[:n], "id bigint, v int")
        want = {r["id"]: r["t"] for r in df.selectExpr("id", "ntile(5) over (order by v, id) t").collect()}
        cuts = ntile_cuts(df, F.col("v"), "id", 5)
        assert len(cuts) <= 4
        got = {r["id"]: r["t"] for r in df.select("id", tile_of(F.col("v"), F.col("id"), cuts).alias("t")).collect()}
        assert got == want


def test_salted_product_equals_the_join(spark):
    from agora.operators.joins import salted_product

    sides = [[("hot", f"{n}{i}") for i in range(40)] + [(f"k{i}", f"{n}{i}") for i in range(5)] + [(None, f"{n}x")] for n in "abc"]
    counts = {"hot": 40, None: 1, **{f"k{i}": 1 for i in range(5)}}
    frames = [(spark.createDataFrame([(k, v, *[counts[k]] * 3) for k, v in rows], f"k string, {n} string, na int, nb int, nc int"), f"n{n}")
              for n, rows in zip("abc", sides)]
    got = salted_product("k", frames, cell=8)
    assert got.count() == 40 ** 3 + 5 + 1 and got.distinct().count() == got.count()
    # the hot key's product is spread over many cells
    assert sorted(got.columns) == ["a", "b", "c", "k"]
