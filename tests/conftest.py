import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from checks.compare import session

    return session()


@pytest.fixture
def folder(tmp_path):
    """Scratch folder of one test."""
    return str(tmp_path)
