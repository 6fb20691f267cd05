import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_SMALL = "/root/testdata/sf0.001"
SF_GATE = os.environ.get("SPENDLENS_TEST_SF", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark():
    from spendlens.session import local_session

    with tempfile.TemporaryDirectory(prefix="spendlens-tests-") as folder:
        session = local_session("*", shuffle_partitions=8, checkpoint=folder)
        yield session
        session.stop()
