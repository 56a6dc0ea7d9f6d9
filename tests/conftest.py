import pytest

from spanloom.session import session


def make_session(**conf):
    return session(
        "tests",
        "local[8]",
        **{
            "spark__sql__shuffle__partitions": "8",
            "spark__ui__enabled": "false",
            "spark__driver__memory": "8g",
            "spark__sql__session__timeZone": "UTC",
            **conf,
        },
    )


@pytest.fixture(scope="session")
def spark():
    one = make_session()
    one.sparkContext.setLogLevel("ERROR")
    yield one
    one.stop()
