import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pairflow.session import local_session

    session = local_session(app_name="pairflow-tests")
    yield session
    session.stop()


@pytest.fixture
def plan():
    """The executed plan of a DataFrame as text."""

    def text(df):
        return df._jdf.queryExecution().executedPlan().toString()

    return text
