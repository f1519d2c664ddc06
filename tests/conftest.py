import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from veriframe.session import SESSION_DEFAULTS  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    )
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    return session


@pytest.fixture(scope="session")
def users(spark):
    return spark.createDataFrame(
        [("user1@example.com", "John Doe", 25), ("user2@example.com", "Jane Smith", 30),
         ("invalid-email", "Bob Johnson", 35), (None, "Alice Brown", 28)],
        "email string, name string, age bigint",
    )


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
