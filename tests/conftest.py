import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from terrasphere.session import local_session

    s = local_session(8, shuffle_partitions=4)
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
