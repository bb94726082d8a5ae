import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from dossier.session import build_session

    work = tmp_path_factory.mktemp("spark")
    session = build_session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="4g",
        spark__sql__warehouse__dir=str(work / "warehouse"),
        spark__checkpoint__dir=f"file://{work}/checkpoint",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
