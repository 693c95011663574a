import os
import sys
import tempfile

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

sys.path.insert(0, REPO)
# the tasks' Python finds the library too
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [REPO, os.environ.get("PYTHONPATH")]))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from urbanlens.session import build_session

    s = build_session(cores="*", shuffle_partitions=8)
    if not s.conf.get("spark.checkpoint.dir", None):  # tests set their own folder where none is set
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_small():
    return SMALL
