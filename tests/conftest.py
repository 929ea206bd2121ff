import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from starloom.session import local_session

    warehouse = str(tmp_path_factory.mktemp("warehouse"))
    session = local_session(
        "tests", "8", "6g", spark__sql__shuffle__partitions="4", spark__sql__codegen__wholeStage="false", spark__sql__warehouse__dir=warehouse
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
