import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
for p in (ROOT, ROOT / "tests"):
    sys.path.insert(0, str(p))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from scorekit.staging import local_session, staging_scope

    session = local_session(8, 4)
    with staging_scope(session):
        yield session


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def users(spark, sf_dir):
    """The user table, written once."""
    from scorekit.sources.user_table import user_table
    from scorekit.staging import materialize

    return materialize(user_table(spark, sf_dir), "users")
