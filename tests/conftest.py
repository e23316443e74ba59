import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from strandlake.session import local_session

    session = local_session(4, "tests", spark__sql__shuffle__partitions="4", spark__default__parallelism="4")
    yield session
    session.stop()
