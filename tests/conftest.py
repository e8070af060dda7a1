import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("TALLYFORGE_DRIVER_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark():
    from tallyforge.session import local_session

    s = local_session(cores=4, shuffle_partitions=2, app="tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
