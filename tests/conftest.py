import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tempovar.session import local_session
    s = local_session(cpus=2, shuffle_partitions=4, app="tempovar-tests")
    yield s
    s.stop()
