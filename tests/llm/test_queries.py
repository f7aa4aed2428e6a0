import pytest

from agora.llm.queries import ORACLE_SQL, QUERIES


def test_one_query_for_each_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith("op11_")])
def test_one_row_for_each_input_row(spark, name):
    sf = "/root/testdata/sf0.001"
    table = "pages" if name.startswith(("op10_", "op13_")) else "documents"
    key = "page_id" if table == "pages" else "doc_id"
    got = [r[0] for r in QUERIES[name](spark, sf).select(key).collect()]
    want = [r[0] for r in spark.read.parquet(f"{sf}/{table}.parquet").select(key).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_rows_equal_the_sql(spark, name):
    from checks.compare import compare_frames, duck

    sf = "/root/testdata/sf0.001"
    got = compare_frames(QUERIES[name](spark, sf).toPandas(), duck(sf).execute(ORACLE_SQL[name]).df())
    assert got["exact"] and got["spark_rows"], got
