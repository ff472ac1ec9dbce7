import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tessera.session import local_session

    return local_session(memory="6g", spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")))
