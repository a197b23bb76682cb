import sys
import tempfile

import pytest
from settings import ROOT

sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from parkops.session import get_session
    scratch = tempfile.mkdtemp(prefix="parkops-test-")
    s = get_session("local[4]", app_name="parkops-tests", shuffle_partitions=4,
                    extra={"spark.checkpoint.dir": scratch})
    yield s
    from parkops.session import cleanup_scratch
    cleanup_scratch(s)
    s.stop()
