import __spark_entry__ as entry
from agora.plans.catalog import registry


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["order_month", "total_orders", "unique_customers", "revenue",
                          "avg_order_value"]


def test_every_query_has_an_oracle():
    assert set(registry()) <= set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 40
