import pathlib
import sys

import pytest

sys.path[:0] = [str(pathlib.Path(__file__).resolve().parents[1]), str(pathlib.Path(__file__).resolve().parent)]

from lodestone.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("lodestone-tests", cpus=4, memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
