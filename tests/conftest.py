import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cohortex.session import checkpoint_dir, get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", 4, extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="cohortex-test-")})
    checkpoint_dir(s)
    yield s
