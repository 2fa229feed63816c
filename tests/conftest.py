"""One local session for all tests."""

import pytest
from pyspark.sql import SparkSession

from weftgraph.model import GraphSpace


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{folder}/shared")
        .config("spark.sql.warehouse.dir", f"{folder}/warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def people(spark):
    """Four people who know each other: 1 -> 2, 1 -> 3, 2 -> 3, 3 -> 4."""
    person = spark.createDataFrame([(1, "Alice", 30, "NY"), (2, "Bob", 25, "LA"), (3, "Charlie", 35, "NY"), (4, "David", 28, None)], "id long, name string, age long, city string")
    knows = spark.createDataFrame([(1, 2, 1.0), (1, 3, 5.0), (2, 3, 1.0), (3, 4, 1.0)], "s long, d long, w double")
    space = GraphSpace(spark, "people")
    space.add_tag("Person", person, "id")
    space.add_edge("KNOWS", knows, "s", "d", None, "Person", "Person")
    return space


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
