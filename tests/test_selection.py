"""Order statistics by histogram selection and distinct counts without Expand, against plain versions."""

import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from agora.operators import selection
from agora.operators.distinct import sums_with_distincts
from agora.operators.selection import quantiles_by_selection, rows_at_ranks, top_sum


@pytest.fixture
def few_bins(monkeypatch):
    monkeypatch.setattr(selection, "BINS", 16)
    monkeypatch.setattr(selection, "LEAF", 3)


def key(row):
    v, i = row
    return v is not None, v if v is not None else 0, i is not None, i.encode() if isinstance(i, str) else i or 0


TEXTS = ["", "a", "ab", "abcdef", "abcdefg", "abcdef\x00", "é", "customer#0001", "customer#0002", "customer#00020", "日本", None]


@pytest.mark.parametrize("value_type, make", [
    ("bigint", lambda r: r.choice([None, 5, 5, 5, -(1 << 63), (1 << 63) - 1, r.randint(-9, 9)])),
    ("double", lambda r: r.choice([None, 0.5, 0.5, 1e300, -1e-300, 1e8 + r.random(), r.gauss(0, 1)])),
    ("decimal(28,2)", lambda r: r.choice([None, Decimal("7.01"), Decimal("7.01"), Decimal(r.randint(0, 10 ** 6)) / 100]))])
@pytest.mark.parametrize("id_type", ["string", "bigint"])
def test_rows_at_all_ranks(spark, few_bins, value_type, make, id_type):
    rng = random.Random(value_type + id_type)
    ids = TEXTS if id_type == "string" else [None, 0, 7, -(1 << 63), (1 << 63) - 1, *range(20, 30)]
    rows = [(make(rng), rng.choice(ids)) for _ in range(40)]
    df = spark.createDataFrame(rows, f"v {value_type}, i {id_type}")
    want = sorted(rows, key=key)
    n, got = rows_at_ranks(df, F.col("v"), lambda n: [-1, *range(0, n, 9), n - 1, n], "i")
    assert n == 40 and got == {k: want[k] for k in [*range(0, 40, 9), 39]}
    n, alone = rows_at_ranks(df, F.col("v"), lambda n: [0, 20, 39])
    assert alone == {k: (want[k][0], None) for k in (0, 20, 39)}


def test_a_value_of_a_third_of_all_rows(spark, few_bins):
    rows = [(1 if i % 3 else i, f"customer{i * 7919 % 100000:09d}") for i in range(900)]
    want = sorted(rows, key=key)
    _, got = rows_at_ranks(spark.createDataFrame(rows, "v int, i string"), F.col("v"), lambda n: [1, 200, 450, 601], "i")
    assert got == {k: want[k] for k in (1, 200, 450, 601)}


def test_empty_and_single(spark):
    df = spark.createDataFrame([], "v double, i string")
    assert rows_at_ranks(df, F.col("v"), lambda n: [0], "i") == (0, {})
    assert spark.range(1).select(quantiles_by_selection(df, F.col("v"), [0.0, 0.5])).first()[0] == [None, None]
    assert top_sum(df, F.col("v"), lambda n: n // 10) == (0, None)
    one = spark.createDataFrame([(2.5, "x"), (None, "y")], "v double, i string")
    assert rows_at_ranks(one, F.col("v"), lambda n: [0, 1], "i")[1] == {0: (None, "y"), 1: (2.5, "x")}


@pytest.mark.parametrize("n", [1, 2, 11, 500])
def test_quantiles_and_top_sum(spark, few_bins, n):
    rng = np.random.default_rng(n)
    values = np.where(rng.random(n) < 0.3, 10.0, rng.lognormal(3, 2, n).round(2))
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    probs = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]
    got = spark.range(1).select(quantiles_by_selection(df, F.col("v"), probs)).first()[0]
    assert got == pytest.approx(np.quantile(values, probs), abs=1e-9, rel=1e-15)
    for share in (0.1, 0.5, 1.0):
        k = int(n * share)
        count, total = top_sum(df.where("v is not null"), F.col("v"), lambda n: int(n * share))
        assert count == n and (total or 0.0) == pytest.approx(np.sort(values)[::-1][:k].sum())


def test_selection_neither_sorts_nor_shuffles_rows(spark, monkeypatch):
    df = spark.range(100_000).select((F.col("id") * 7919 % 100_003).alias("v"), F.col("id").cast("string").alias("i"))
    _, got = rows_at_ranks(df, F.col("v"), lambda n: [n // 2], "i", leaf=10)
    assert got[50_000][0] == sorted(i * 7919 % 100_003 for i in range(100_000))[50_000]


@pytest.mark.parametrize("null_a", [True, False])
def test_distincts_equal_count_distinct(spark, null_a):
    rng = random.Random(3)
    rows = [(rng.choice(["g", "g", "h", None]), rng.choice([None, 1, 2, 3, 4] if null_a else [1, 2, 3]), rng.choice([None, "a", "b", "c"]),
             Decimal(rng.randint(0, 999)) / 100) for _ in range(300)] + [("all", None if null_a else 1, None, None)]
    df = spark.createDataFrame(rows, "g string, a int, b string, x decimal(18,2)")
    for groups in (["g"], []):
        got = sums_with_distincts(df, groups, ("a", "n_a"), ("b", "n_b"), {"x": F.sum("x"), "n": F.count(F.lit(1))}, null_a=null_a)
        want = df.groupBy(*groups).agg(F.countDistinct("a").alias("n_a"), F.countDistinct("b").alias("n_b"), F.sum("x").alias("x"),
                                       F.count(F.lit(1)).alias("n"))
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    nothing = sums_with_distincts(df.limit(0), [], ("a", "n_a"), ("b", "n_b"), {"x": F.sum("x")}, null_a=null_a).collect()
    assert [tuple(r) for r in nothing] == [(0, 0, None)]


def test_no_plan_expands_rows(spark):
    from agora.plans.catalog import registry
    from tests.conftest import SF0001

    for name in ("sql_kpi_overview", "sql_monthly_revenue", "sql_state_revenue", "py_kpis", "py_monthly_revenue", "py_revenue_by_state"):
        plan = registry()[name](spark, SF0001)._jdf.queryExecution().executedPlan().toString()
        assert "Expand" not in plan, name


def test_edges_and_tiles_come_without_a_written_rank(spark, monkeypatch):
    from agora.operators import quantiles, ranking
    from agora.plans.catalog import registry
    from tests.conftest import SF0001

    def refuse(*args, **kwargs):
        raise AssertionError("all rows were ranked")

    monkeypatch.setattr(ranking, "global_rank", refuse)
    monkeypatch.setattr(quantiles, "global_rank", refuse)
    for name in ("sql_rfm", "py_rfm", "py_seller_concentration"):
        assert registry()[name](spark, SF0001).count() > 0
