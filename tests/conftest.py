import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quern.session import local_session

    session = local_session("quern-tests", 4, spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")), spark__checkpoint__dir="file://" + str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()
