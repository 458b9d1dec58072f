import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from rfsense.session import build

    s = build("tests", "local[8]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
              spark__driver__memory="8g")
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def small_pieces(monkeypatch):
    """Treat every device as hot: pieces of a few dozen rows."""
    from rfsense.operators import layout

    monkeypatch.setattr(layout, "PIECE_ROWS", 40)
    monkeypatch.setattr(layout, "BIN_SECONDS", 0.25)
