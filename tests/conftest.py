import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from reviewgrid.session import get_spark
    s = get_spark(master="local[4]", shuffle_partitions=4)
    yield s


def diff_frame(spark, diffs):
    rows = [("org/r", i, f"sha{i}", d) for i, d in enumerate(diffs)]
    return spark.createDataFrame(rows, "repo string, pr_number int, commit_sha string, diff string")
