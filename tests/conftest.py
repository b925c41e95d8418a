from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from rollcall.session import build_session
    s = build_session(master="local[4]", shuffle_partitions=4, app_name="rollcall-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def dom(spark):
    from rollcall.sources.views import Domain
    return Domain(spark, SMALL)


def rows(df, *cols, order=None):
    """Collected rows as sorted tuples of the named columns."""
    cols = cols or tuple(df.columns)
    out = [tuple(r[c] for c in cols) for r in df.select(*cols).collect()]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t)) if order is None else out
