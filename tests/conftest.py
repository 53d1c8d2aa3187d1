import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tracewarden.session import local_session

    return local_session(app="tests")


@pytest.fixture(scope="session")
def events(spark):
    from tracewarden.plans.adapter import load_events

    return load_events(spark, SF)


@pytest.fixture(scope="session")
def make(spark):
    """make([(second, actor, source, raw_event_id), ...]) -> events."""
    from datetime import datetime, timedelta

    from tracewarden.schema import EVENT

    def build(rows, start=datetime(2024, 1, 15, 12)):
        full = []
        for i, (second, actor, source, number, *rest) in enumerate(rows):
            kind = "auth" if number in (4624, 4625) else "config"
            severity = rest[0] if rest else 5
            full.append((f"e{i:04d}", start + timedelta(seconds=second), "windows", source, actor, source, kind, severity,
                         number, "", "", "", ""))
        return spark.createDataFrame(full, EVENT)

    return build
