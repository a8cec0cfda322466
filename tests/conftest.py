import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from foliant.session import local_session

    with tempfile.TemporaryDirectory(prefix="checkpoints-") as shared:
        yield local_session("tests", cpus=int(os.environ.get("TEST_CPUS", "4")), **{"spark.checkpoint.dir": shared})
