import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

# One sample lactation as day in milk, milk, fat % and protein %.
LACTATION = [
    (13, 45, 10.0, 2.7),
    (41, 73, 2.5, 2.9),
    (68, 81, 3.0, 2.9),
    (107, 81, 2.5, 2.7),
    (132, 83, 4.0, 3.1),
    (167, 81, 2.1, 3.1),
    (195, 80, 3.2, 3.1),
    (226, 72, 3.1, 3.0),
    (254, 79, 2.7, 3.1),
    (283, 71, 2.5, 3.3),
    (310, 69, 3.3, 3.0),
    (346, 69, 3.7, 3.0),
    (377, 65, 2.8, 3.0),
    (405, 61, 4.0, 3.2),
]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[8]")
        .appName("lactoscope-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", str(folder / "warehouse"))
        .config("spark.checkpoint.dir", str(folder / "shared"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def lactation(spark, tmp_path_factory):
    """The sample lactation, read from a CSV file with a leading row number."""
    from lactoscope.sources.tables import SINGLE_LACTATION_CSV, read_csv

    path = tmp_path_factory.mktemp("csv") / "lactation.csv"
    lines = ['"","LACT","BDAT","FDAT","TestDate","DIM","MILK","PCTF","PCTP"']
    for i, (dim, milk, fat, protein) in enumerate(LACTATION):
        lines.append(f'"{100 + i}",1,2016-06-26,2018-05-26,2018-06-08,{dim},{milk},{fat},{protein}')
    path.write_text("\n".join(lines) + "\n")
    return read_csv(spark, str(path), SINGLE_LACTATION_CSV)
