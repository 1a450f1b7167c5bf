import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from textloom.session import build

    return build("textloom-tests", cores="8", partitions=4, memory="6g")
