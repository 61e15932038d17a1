import sys
import tempfile
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from panelspark.session import panel_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = panel_session(
        "tests", "local[4]",
        spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__driver__memory="4g", spark__sql__maxMetadataStringLength="2000",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="panelspark-tests-"),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows():
    """Rows of a frame as sorted tuples, NULL first."""

    def collect(df, *cols):
        picked = df.select(*cols) if cols else df
        return sorted((tuple(r) for r in picked.collect()), key=lambda r: [(v is not None, str(v)) for v in r])

    return collect


def plan_of(df) -> str:
    """The physical plan as text, before AQE starts."""
    return df._jdf.queryExecution().executedPlan().toString()
