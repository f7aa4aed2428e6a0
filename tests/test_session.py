import os
import subprocess
import sys

from pyspark.sql import functions as F

from agora.plans import revenue
from agora.plans.catalog import Workspace
from agora.session import Scratch, application_scratch, checkpoint_dir, release_staged, stage
from tests.conftest import ROOT
from tests.handmade import money, order, tables


def test_stage_cuts_lineage_and_keeps_values(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    staged = stage(df)
    assert sorted(r.x for r in staged.collect()) == [2 * i for i in range(100)]
    plan = staged._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan  # reads the written table, not the original plan


def test_checkpoint_dir_is_read_from_session(spark):
    path = checkpoint_dir(spark)
    assert path and path == spark.sparkContext.getCheckpointDir()


def files_below(folder):
    path = folder.removeprefix("file:")
    return [f for _, _, names in os.walk(path) for f in names]


def test_scratch_deletes_what_it_wrote(spark):
    scratch = Scratch(spark)
    assert scratch.stage(spark.range(5)).count() == 5 and files_below(scratch.folder)
    scratch.close()
    assert not files_below(scratch.folder)


def one_payment(spark, value):
    return tables(spark, orders=[order("o1", "c1", "delivered", "2018-01-01 10:00:00")],
                  customers=[("c1", "u1", "SP")], payments=[("o1", 1, "boleto", 1, money(value))])


def test_a_workspace_owns_its_sides(spark):
    """Another workspace with other tables never sees them."""
    with Workspace(spark, one_payment(spark, 5), materialize=True) as first, \
            Workspace(spark, one_payment(spark, 999), materialize=True) as second:
        assert revenue.kpis(first.delivered).first().total_revenue == 5.0
        assert revenue.kpis(second.delivered).first().total_revenue == 999.0
        folders = [first.scratch.folder, second.scratch.folder]
        assert all(files_below(f) for f in folders)
    assert not any(files_below(f) for f in folders)


def test_nothing_is_left_after_a_run(tmp_path):
    """A whole batch run, and a process that never cleans up itself, leave an empty folder."""
    code = """
import sys
sys.path.insert(0, {root!r})
from agora.session import build_session, stage
spark = build_session("local[2]", shuffle_partitions=2, extra_conf={{"spark.checkpoint.dir": {ckpt!r}, "spark.driver.memory": "2g"}})
stage(spark.range(10)).count()
if {batch}:
    from agora.__main__ import main
    main(["--tpch", "/root/testdata/sf0.001", "--out", {out!r}, "--skip-master"])
"""
    for batch in (False, True):
        ckpt = str(tmp_path / f"ckpt{batch}")
        subprocess.run([sys.executable, "-c", code.format(root=ROOT, ckpt=ckpt, out=str(tmp_path / "out"), batch=batch)],
                       check=True, timeout=900, capture_output=True)
        assert not files_below(ckpt)


def test_defaults_never_replace_a_setting(tmp_path):
    code = """
import sys
sys.path.insert(0, {root!r})
from pyspark import SparkConf, SparkContext
sc = SparkContext("local[1]", "t", conf=SparkConf().set("spark.sql.adaptive.enabled", "false").set("spark.ui.enabled", "false"))
from agora.session import build_session
spark = build_session()
assert spark.conf.get("spark.sql.adaptive.enabled") == "false"
assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
"""
    subprocess.run([sys.executable, "-c", code.format(root=ROOT)], check=True, timeout=300, capture_output=True)


def test_release_staged(spark):
    stage(spark.range(3))
    folder = application_scratch(spark).folder
    assert files_below(folder)
    release_staged(spark)
    assert not files_below(folder)
