import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from urnframe.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-"),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def baskets_of(spark):
    def build(*rows, lottery_id=1):
        data = [(lottery_id, n, list(numbers)) for n, numbers in rows]
        return spark.createDataFrame(
            data, "lottery_id int, draw_number bigint, numbers array<int>"
        )

    return build


@pytest.fixture
def rules_of(spark):
    def build(low=1, high=45, pick=6, super_min=1, super_max=12):
        return spark.createDataFrame(
            [(1, "A", low, high, pick, super_min, super_max)],
            "lottery_id int, code string, min_number int, max_number int, numbers_to_select int,"
            " super_min int, super_max int",
        )

    return build
