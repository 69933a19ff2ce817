import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from skerry.session import build

    session = build("local[4]", 4, **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "3g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(DATA):
        pytest.skip(f"no tables in {DATA}")
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    connection = duckdb.connect()
    for name in os.listdir(sf_dir):
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    return connection


def rows_of(frame):
    """Rows as comparable tuples, columns by name, floats rounded."""
    import pandas as pd

    frame = frame[sorted(frame.columns)]

    def plain(v):
        if v is None or (not isinstance(v, (list, dict, bytes)) and pd.isna(v)):
            return "~"
        if isinstance(v, bool):
            return str(v)
        try:
            return f"{round(float(v), 6) + 0.0:.6f}" if not isinstance(v, str) else v
        except (TypeError, ValueError):
            return str(v)

    return sorted(tuple(map(plain, r)) for r in frame.astype(object).itertuples(index=False))
