import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from marginalia.session import local_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4)
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    """Table of notes from a dict of path -> content."""

    def notes(contents):
        return spark.createDataFrame(list(contents.items()), "path string, content string")

    return notes
