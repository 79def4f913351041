import os

import pytest

from opgraph.session import get_or_create


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("BENCH_CPUS", "4")
    session = get_or_create(**{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
