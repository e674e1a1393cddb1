import pytest
from pyspark.sql import SparkSession

LIMIT = "spark.loadlens.groupLimit"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(params=["whole", "split"])
def both_ways(request, spark):
    """Run a test with whole groups and again with every group split."""
    if request.param == "split":
        spark.conf.set(LIMIT, "3")
    yield request.param
    spark.conf.unset(LIMIT)


@pytest.fixture
def plan():
    """Text of the physical plan of a DataFrame, before it runs."""
    return lambda df: df._jdf.queryExecution().executedPlan().toString()
