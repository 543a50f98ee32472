from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from fleetviews import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "fleetviews-tests", "local[8]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false"
    )
    session.sparkContext.setLogLevel("OFF")
    return session
