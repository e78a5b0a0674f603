import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from taskscope.session import local_session, shared_dir  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, 4, "4g")
    shared_dir(session)
    yield session
    session.stop()


@pytest.fixture
def many_ranges(spark):
    """Small ranges stay apart, so that every key reaches over several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def tuples(df, *columns):
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=repr)
