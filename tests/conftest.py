import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tests.harness import local_session  # noqa: E402

# column literals at module level need a running session
SESSION = local_session()


@pytest.fixture(scope="session")
def spark():
    return SESSION
