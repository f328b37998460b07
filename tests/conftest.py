import os
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(ROOT), os.environ.get("PYTHONPATH")]))

import pytest  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from fidelis.session import session

    folder = tmp_path_factory.mktemp("spark")
    s = session("tests", "4", spark__driver__memory="3g", spark__sql__shuffle__partitions="4", spark__checkpoint__dir=f"file://{folder}/checkpoints", spark__sql__warehouse__dir=f"{folder}/warehouse", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return DATA
