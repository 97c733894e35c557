import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from textpool.session import local_session
    s = local_session(cores=4, shuffle_partitions=4, app="textpool-tests")
    from textpool.session import checkpoint_root
    checkpoint_root(s)  # the configured spark.checkpoint.dir, or a private folder when unset
    yield s


SF_SMALL = "/root/testdata/sf0.001"
