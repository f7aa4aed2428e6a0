import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.01"
SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from agora.session import build_session, checkpoint_dir

    session = build_session("local[4]", app_name="agora-tests", shuffle_partitions=4)
    checkpoint_dir(session)
    yield session
