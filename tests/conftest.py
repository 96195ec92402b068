import pytest

from rowtide.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("tests", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
