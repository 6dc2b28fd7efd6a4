from __future__ import annotations

import os

import pytest

from tests.compare import connect, session

DATA = os.environ.get("TEST_DATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    return session("4")


@pytest.fixture(scope="session")
def sf_dir():
    path = f"{DATA}/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("driver tables are not here")
    return path


@pytest.fixture(scope="session")
def sf01_dir():
    path = f"{DATA}/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("driver tables are not here")
    return path


@pytest.fixture(scope="session")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.fixture
def path(tmp_path):
    return str(tmp_path)
