import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from matchspark.session import ensure_checkpoint_dir, local_session

    session = local_session(4, "matchspark-tests")
    ensure_checkpoint_dir(session)
    yield session
    session.stop()
