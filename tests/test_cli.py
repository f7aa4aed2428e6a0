import os
import tempfile

from agora.__main__ import main
from tests.conftest import SF0001


def test_whole_workload_run(spark, capsys):
    out = tempfile.mkdtemp(prefix="agora-run-")
    main(["--tpch", SF0001, "--out", out, "--skip-master"])
    written = set(os.listdir(out))
    assert "py_kpis" in written and "sql_rfm" in written and "py_master" not in written
    assert {"rfm_customer_segments", "top_sellers"} <= set(os.listdir(os.path.join(out, "export")))
    assert "total_revenue" in capsys.readouterr().out
