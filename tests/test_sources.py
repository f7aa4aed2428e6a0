import os
import tempfile

import pytest

from agora.plans.fanout import build_fanout, master_rows
from agora.sources import read_marketplace_csv, read_marketplace_parquet
from agora.sources.schemas import COLUMN_TYPES
from agora.sources.sinks import SUMMARY_SHEETS, export_rfm, export_summaries
from agora.plans.catalog import tpch_workspace
from tests.conftest import SF001

HEADERS = {t: ",".join(cols) for t, cols in COLUMN_TYPES.items()}


def write_csv_folder(folder, rows_by_table, bom_tables=()):
    for table, header in HEADERS.items():
        text = header + "\n" + "".join(r + "\n" for r in rows_by_table.get(table, []))
        data = text.encode("utf-8")
        if table in bom_tables:
            data = b"\xef\xbb\xbf" + data
        with open(os.path.join(folder, f"{table}.csv"), "wb") as fh:
            fh.write(data)


def test_csv_bom_quoted_newline_and_types(spark):
    folder = tempfile.mkdtemp(prefix="agora-csv-")
    write_csv_folder(folder, {
        "orders": ['o1,c1,delivered,2018-01-01 10:00:00,2018-01-01 11:00:00,'
                   '2018-01-02 10:00:00,2018-01-05 09:00:00,2018-01-20 00:00:00'],
        "order_items": ["o1,1,p1,s1,10.50,1.25"],
        "products": ['p1,"beleza_saude",100,10'],
        "customers": ["c1,u1,SP"],
        "payments": ["o1,1,credit_card,3,11.75"],
        "reviews": ["o1,5"],
        "sellers": ['s1,"Sao\nPaulo",SP'],                      # quoted newline
        "category_translation": ["beleza_saude,health_beauty"],
    }, bom_tables=("category_translation",))
    t = read_marketplace_csv(spark, folder)
    assert t.sellers.count() == 1 and t.sellers.first().seller_city == "Sao\nPaulo"
    assert t.category_translation.columns[0] == "product_category_name"
    assert dict(t.payments.dtypes)["payment_value"] == "decimal(18,2)"
    assert dict(t.orders.dtypes)["order_purchase_timestamp"] == "timestamp_ntz"
    row = master_rows(build_fanout(t), t).first()
    assert row.product_category_name_english == "health_beauty"
    assert row.delivery_days == 3 and float(row.payment_value) == 11.75


def test_csv_bad_date_fails(spark):
    folder = tempfile.mkdtemp(prefix="agora-csv-")
    write_csv_folder(folder, {"orders": ["o1,c1,delivered,not-a-date,,,,"]})
    t = read_marketplace_csv(spark, folder)
    with pytest.raises(Exception):
        t.orders.collect()


def test_parquet_roundtrip_and_sinks(spark):
    w = tpch_workspace(spark, SF001)
    folder = tempfile.mkdtemp(prefix="agora-pq-")
    for name, df in w.tables.as_dict().items():
        df.write.parquet(os.path.join(folder, name))
    t = read_marketplace_parquet(spark, folder)
    assert t.orders.count() == w.tables.orders.count()
    out = tempfile.mkdtemp(prefix="agora-out-")
    paths = export_summaries(w.delivered, w.rfm, out)  # factorised delivered view
    assert set(paths) == set(SUMMARY_SHEETS)
    assert spark.read.parquet(paths["top_sellers"]).count() == 50
    assert spark.read.parquet(paths["category_revenue"]).count() == 15
    rfm_path = export_rfm(w.rfm, out)
    back = spark.read.option("header", True).csv(rfm_path)
    assert back.count() == 1429 and "segment" in back.columns


def csv_folder(**rows):
    folder = tempfile.mkdtemp(prefix="agora-csv-")
    write_csv_folder(folder, rows)
    return folder


def test_missing_value_strings_are_null(spark):
    folder = csv_folder(payments=["o1,1,NA,1,nan", "o2,1,null,N/A,2.50", "o3,1,na,2,3.00"])
    rows = {r.order_id: r for r in read_marketplace_csv(spark, folder).payments.collect()}
    assert rows["o1"].payment_type is None and rows["o1"].payment_value is None
    assert rows["o2"].payment_type is None and rows["o2"].payment_installments is None
    assert rows["o3"].payment_type == "na"
    kept = read_marketplace_csv(spark, csv_folder(payments=["o1,1,NA,1,2.50"]), missing_values=[""])
    assert kept.payments.first().payment_type == "NA"


@pytest.mark.parametrize("amount", ["10.129", "0.004", "99999999999999999.00"])
def test_money_is_never_rounded(spark, amount):
    with pytest.raises(Exception):
        read_marketplace_csv(spark, csv_folder(payments=[f"o1,1,boleto,1,{amount}"])).payments.collect()
    assert read_marketplace_csv(spark, csv_folder(payments=["o1,1,boleto,1,10.10"])).payments.first().payment_value is not None


def test_every_table_needs_its_columns(spark):
    folder = csv_folder()
    with open(os.path.join(folder, "reviews.csv"), "w") as fh:
        fh.write("order_id,comment\no1,x\n")
    with pytest.raises(ValueError, match="review_score"):
        read_marketplace_csv(spark, folder)


def test_single_line_csv_is_split(spark):
    lines = [f"o{i},1,boleto,1,1.50" for i in range(20_000)]
    folder = csv_folder(payments=lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        one = read_marketplace_csv(spark, folder, multiline="whole").payments
        many = read_marketplace_csv(spark, folder, multiline=False).payments
        ranges = read_marketplace_csv(spark, folder).payments
        assert one.rdd.getNumPartitions() == 1 < many.rdd.getNumPartitions()
        assert ranges.rdd.getNumPartitions() == many.rdd.getNumPartitions()
        assert ranges.count() == many.count() == one.count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_uris_are_kept(spark):
    w = tpch_workspace(spark, "file://" + SF001)
    assert w.tables.orders.count() == tpch_workspace(spark, SF001).tables.orders.count()


def test_a_failed_export_leaves_the_former_one_whole(spark, tmp_path, monkeypatch):
    from agora.sources import sinks

    w, out = tpch_workspace(spark, "/root/testdata/sf0.001"), str(tmp_path)
    paths = export_summaries(w.delivered, w.rfm, out)
    run = open(f"{out}/{sinks.MARKER}").read()
    before = {name: spark.read.parquet(p).count() for name, p in paths.items()}
    frames = sinks.summary_frames(w.delivered, w.rfm)
    broken = {**frames, "top_sellers": frames["top_sellers"].selectExpr("raise_error('no')")}
    with monkeypatch.context() as m:
        m.setattr(sinks, "summary_frames", lambda *a: broken)
        with pytest.raises(Exception, match="no"):
            export_summaries(w.delivered, w.rfm, out)
    assert open(f"{out}/{sinks.MARKER}").read() == run
    assert {name: spark.read.parquet(p).count() for name, p in paths.items()} == before
    assert sorted(f for f in os.listdir(out) if not f.startswith(".")) == sorted([*paths, sinks.MARKER])
    with pytest.raises(FileExistsError):
        export_summaries(w.delivered, w.rfm, out, mode="error")
    export_summaries(w.delivered, w.rfm, out, fmt="csv")
    assert open(f"{out}/{sinks.MARKER}").read() != run
    assert spark.read.option("header", True).csv(paths["top_sellers"]).count() == before["top_sellers"]


def test_a_changed_file_inside_a_table_folder_is_noticed(spark, tmp_path):
    from agora.plans.catalog import _folder_state

    spark.range(3).write.parquet(f"{tmp_path}/x.parquet")
    state = _folder_state(spark, str(tmp_path))
    assert _folder_state(spark, str(tmp_path)) == state
    spark.range(4).write.mode("append").parquet(f"{tmp_path}/x.parquet")
    assert _folder_state(spark, str(tmp_path)) != state
