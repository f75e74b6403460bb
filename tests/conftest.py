import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from sluicebed.session import local_session

    s = local_session(4, "tests", "6g")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    from sluicebed.plans.shared import clear

    clear(s)
    s.stop()


DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def data():
    if not DATA.exists():
        pytest.skip("no test tables here")
    return str(DATA)
