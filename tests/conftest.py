import sys
from contextlib import contextmanager
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from orderloom.session import builder  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        builder("tests")
        .master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_folder():
    return "/root/testdata/sf0.001"


@contextmanager
def session_settings(session, settings):
    """Session settings for the length of a block."""
    before = {key: session.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            session.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                session.conf.unset(key)
            else:
                session.conf.set(key, value)
