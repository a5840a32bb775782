from __future__ import annotations

import functools
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from failwatch.session import local_session

    session = local_session(8, "8g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def entries():
    """All registered queries; stage tables are shared between the tests."""
    from registry import adapter

    if not hasattr(adapter.stages, "cache_info"):
        adapter.stages = functools.lru_cache(adapter.stages)
    import registry.jobs_catalog  # noqa: F401
    from registry.catalog import ENTRIES

    return ENTRIES
