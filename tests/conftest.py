import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from cadre.session import local_session
    s = local_session(4, shuffle_partitions=8, app="cadre-tests")
    yield s
    s.stop()


def rows(df, *cols):
    """Sorted plain tuples for comparisons."""
    sel = df.select(*cols) if cols else df
    return sorted(tuple(r) for r in sel.collect())
