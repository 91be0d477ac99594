import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# the whole engine runs in the driver's JVM here; a submitted job sets its own memory
os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 8g pyspark-shell")

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from figura.session import build_session
    s = build_session("local[4]", shuffle_partitions=4, app_name="figura-tests")
    yield s
    s.stop()


def rows(df, *cols):
    """Collected rows as sorted tuples (optionally a column subset)."""
    cols = cols or df.columns
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())
