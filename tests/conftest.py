import tempfile

import pytest

from statemesh.session import local_session


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="statemesh-tests-")
    session = local_session(
        "4",
        4,
        **{
            "spark.sql.warehouse.dir": f"{folder}/warehouse",
            "spark.checkpoint.dir": f"{folder}/shared",
            "spark.driver.memory": "4g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    return session
