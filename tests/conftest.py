import os
import sys

# One thread a process for numpy: Spark's tasks use the cores already.
os.environ.setdefault("OMP_NUM_THREADS", "1")

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from pagelake.session import configure

    s = (
        SparkSession.builder.master("local[4]")
        .appName("pagelake-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    configure(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def pages_fixture(spark):
    """Hand-made pages (FIXTURES.md §4) as a DataFrame."""
    from tests.fixtures import PAGES

    return spark.createDataFrame(PAGES, "page_id long, url string, html string")
