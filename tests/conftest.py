import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from mensura.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions=8, spark__ui__enabled="false", spark__driver__memory="6g"
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def slots_only(monkeypatch):
    """Force the paths meant for groups too large for one task."""
    from mensura.operators import joins, metrics, ordering

    monkeypatch.setattr(ordering, "WINDOW_ROWS", 0)
    monkeypatch.setattr(ordering, "PERCENTILE_ROWS", 0)
    monkeypatch.setattr(metrics, "WINDOW_ROWS", 0)
    real = joins.hot_key_lookup

    def eager(rows, table, on, how="inner", hot_rows=2, share=1 / 2000):
        return real(rows, table, on, how, hot_rows, share)

    for module in (joins, ordering, metrics):
        monkeypatch.setattr(module, "hot_key_lookup", eager)
    from mensura.operators import contrasts, splits

    monkeypatch.setattr(contrasts, "hot_key_lookup", eager)
    monkeypatch.setattr(splits, "hot_key_lookup", eager)
