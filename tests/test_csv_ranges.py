"""The parallel CSV reader against Spark's own multi-line reader, which parses a file in one task."""

import os
import random

import pytest

from agora.sources.csv_ranges import column_names, ends_inside, read_csv_ranges, scan_ranges
from agora.sources.csv_reader import read_typed_csv


def whole_files(spark, path):
    return (spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST").csv(path))


@pytest.fixture
def small_ranges(spark):
    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield use
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def random_csv(seed, rows, line_end="\n", quoted_share=0.5):
    """Fields with commas, doubled quotes, line breaks and quotes in the middle of plain fields."""
    rng = random.Random(seed)
    plain = ["", "a", "x y", '5" disk', "é", "long plain field", "NA", " pad "]
    inner = ["a", ",", '""', "\n", "\n\n", "é", " ", "text", '"",""', "x\n,y", "'"]

    def one():
        if rng.random() < quoted_share:
            return '"' + "".join(rng.choice(inner) for _ in range(rng.randint(0, 8))).replace("\n", line_end) + '"'
        return rng.choice(plain)

    lines = ["id,b,c,d"] + [f"{i},{one()},{one()},{one()}" for i in range(rows)]
    return line_end.join(lines) + (line_end if rng.random() < 0.8 else "")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("seed, line_end, size, share", [
    (1, "\n", 256, 0.5), (2, "\r\n", 256, 0.5), (3, "\n", 64, 0.9), (4, "\n", 1000, 0.05), (5, "\r\n", 97, 0.9), (6, "\n", 1 << 20, 0.5)])
def test_equals_the_multi_line_reader(spark, tmp_path, small_ranges, seed, line_end, size, share):
    for k in range(2):
        with open(f"{tmp_path}/f{k}.csv", "wb") as f:
            f.write((b"\xef\xbb\xbf" if k else b"") + random_csv(seed + 10 * k, 70, line_end, share).encode())
    want = rows_of(whole_files(spark, str(tmp_path)))
    small_ranges(size)
    got = read_csv_ranges(spark, str(tmp_path))
    assert got.columns == ["id", "b", "c", "d"] and len(want) == 140
    assert rows_of(got) == want


def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_ranges):
    text = "order_id,payment_sequential,payment_type,payment_installments,payment_value\n" + "".join(
        f'o{i},1,"bo\nle""to",1,1.50\n' for i in range(5000))
    with open(f"{tmp_path}/p.csv", "w") as f:
        f.write(text)
    small_ranges(16 << 10)
    df = read_typed_csv(spark, f"{tmp_path}/p.csv", "payments")
    assert df.count() == 5000 and {r.payment_type for r in df.select("payment_type").distinct().collect()} == {'bo\nle"to'}
    one = read_typed_csv(spark, f"{tmp_path}/p.csv", "payments", multiline="whole")
    assert rows_of(one) == rows_of(df)
    ranges = scan_ranges(spark, f"{tmp_path}/p.csv")
    assert len(ranges.inside) > 5 and any(ranges.inside.values()) and ranges.crossed
    assert df.select("order_id").rdd.getNumPartitions() > one.rdd.getNumPartitions() == 1


def test_a_record_over_many_ranges(spark, tmp_path, small_ranges):
    long = "\n".join(f"line {i}, of a long field" for i in range(120))
    with open(f"{tmp_path}/x.csv", "w") as f:
        f.write(f'a,b\n1,"{long}"\n2,x\n3,"{long}"\n4,"y"')
    small_ranges(200)
    assert {r.a: r.b for r in read_csv_ranges(spark, f"{tmp_path}/x.csv").collect()} == {"1": long, "2": "x", "3": long, "4": "y"}


def test_changed_ranges_are_noticed(spark, tmp_path, small_ranges):
    with open(f"{tmp_path}/x.csv", "w") as f:
        f.write("a,b\n" + '1,"x\ny"\n' * 500)
    small_ranges(300)
    df = read_csv_ranges(spark, f"{tmp_path}/x.csv")
    small_ranges(301)
    with pytest.raises(Exception, match="byte ranges have changed"):
        df.where("a = '1'").collect()


def test_headers(spark, tmp_path):
    assert column_names('a,"b,c",,A') == ["a0", "b,c", "_c2", "A3"]
    for name, head in (("x", "a,b"), ("y", "a,c")):
        with open(f"{tmp_path}/{name}.csv", "w") as f:
            f.write(f"{head}\n1,2\n")
    with pytest.raises(ValueError, match="differs"):
        read_csv_ranges(spark, str(tmp_path))
    os.makedirs(f"{tmp_path}/e")
    with open(f"{tmp_path}/e/e.csv", "w") as f:
        f.write("a,b\r1,2\r")
    with pytest.raises(ValueError, match="carriage return"):
        read_csv_ranges(spark, f"{tmp_path}/e")


def test_malformed_rows_fail(spark, tmp_path):
    with open(f"{tmp_path}/x.csv", "w") as f:
        f.write("a,b\n1,2\n\n3\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_csv_ranges(spark, f"{tmp_path}/x.csv").collect()


@pytest.mark.parametrize("line, outside, inside", [
    ("a,b", False, True), ('a,"b', True, False), ('"a"', False, False), ('5" disk,x', False, False), ('"a""', True, False),
    ('a"",b', False, True), ('"', True, False), ("", False, True), ('x,"y",z', False, False), ('"x"y,"z', True, True)])
def test_line_states(line, outside, inside):
    assert (ends_inside(line, False), ends_inside(line, True)) == (outside, inside)
