import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tagweave.session import get_spark
    extra = {"spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    spark = get_spark("local[8]", 8, app_name="tagweave-tests", extra=extra)
    # Tests only: a private checkpoint folder when the session names none.
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tw-test-ckpt-"))
    yield spark
    spark.stop()
