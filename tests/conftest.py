import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidemark.session import checkpoint_dir, local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, partitions=4)
    checkpoint_dir(session)
    yield session
    session.stop()
