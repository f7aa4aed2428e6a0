from datetime import datetime

from pyspark.sql import functions as F

from agora.functions import (calendar_days, elapsed_days, exact_mean, field_position,
                             half_up, month_period, pct_of, weekday_name)


def test_elapsed_days_floors_like_timedelta_days(spark):
    rows = [(datetime(2018, 1, 2, 0, 0), datetime(2018, 1, 1, 2, 0)),    # 22h -> 0
            (datetime(2018, 1, 1, 2, 0), datetime(2018, 1, 2, 0, 0)),    # -22h -> -1
            (datetime(2018, 1, 3, 1, 0), datetime(2018, 1, 1, 2, 0)),    # 47h -> 1
            (datetime(2018, 1, 3, 2, 0), datetime(2018, 1, 1, 2, 0)),    # 48h -> 2
            (None, datetime(2018, 1, 1))]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    got = [r[0] for r in df.select(elapsed_days("a", "b")).collect()]
    assert got == [0, -1, 1, 2, None]
    cal = [r[0] for r in df.select(calendar_days("a", "b")).collect()]
    assert cal == [1, -1, 2, 2, None]


def test_elapsed_days_ignores_session_time_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
        # daylight-saving change inside the interval: still 22.5 wall-clock hours
        df = spark.createDataFrame([(datetime(2018, 2, 18, 22, 0), datetime(2018, 2, 17, 23, 30))],
                                   "a timestamp_ntz, b timestamp_ntz")
        assert df.select(elapsed_days("a", "b")).first()[0] == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_calendar_labels(spark):
    df = spark.createDataFrame([(datetime(2017, 11, 24, 20, 5),)], "t timestamp_ntz")
    row = df.select(month_period("t"), weekday_name("t"), F.hour("t")).first()
    assert tuple(row) == ("2017-11", "Friday", 20)


def test_half_up_rounds_an_exact_ratio_once(spark):
    rows = [("10.05", 2, 5.03), ("0.05", 2, 0.03), ("-10.05", 2, -5.03), ("1.00", 3, 0.33), ("2.00", 3, 0.67), ("7", 0, None),
            (None, 1, None), ("2.99", -2, -1.5), ("99999999999999.99", 7, 14285714285714.28)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(rows)], "i int, a string, b bigint")
    got = [r[0] for r in df.orderBy("i").select(half_up(F.col("a").cast("decimal(38,2)"), "b", 2)).collect()]
    assert got == [r[2] for r in rows]
    assert spark.range(1).select(half_up(F.lit(5), F.lit(2), 0), half_up(F.lit(1), F.lit(20), 1)).first()[:] == (3.0, 0.1)


def test_exact_mean_and_pct(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", None)], "k string, v int")
    got = dict(df.groupBy("k").agg(exact_mean("v")).collect())
    assert got == {"a": 1.5, "b": None}
    assert df.select(pct_of(F.lit(1), F.lit(0))).first()[0] is None
    assert df.select(pct_of(F.lit(1), F.lit(4))).first()[0] == 25.0


def test_field_position(spark):
    df = spark.createDataFrame([("Tuesday",), ("Funday",), (None,)], "d string")
    got = [r[0] for r in df.select(field_position("d", ["Monday", "Tuesday"])).collect()]
    assert got == [2, 0, 0]
