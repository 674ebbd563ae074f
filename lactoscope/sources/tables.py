"""Sources and sinks: test-day and herd tables, CSV samples, results."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEST_DAY_SCHEMA = T.StructType(
    [
        T.StructField("SourceCode", T.IntegerType(), False),
        T.StructField("SourceHerdID", T.IntegerType(), False),
        T.StructField("SourceAnimalID", T.LongType(), False),
        T.StructField("EarTag", T.StringType(), False),
        T.StructField("LactationNumber", T.IntegerType(), True),
        T.StructField("BirthDate", T.DateType(), True),
        T.StructField("FreshDate", T.DateType(), True),
        T.StructField("EventDateTime", T.TimestampType(), False),
        T.StructField("DIM", T.IntegerType(), True),
        T.StructField("MilkWeight", T.DoubleType(), True),
        T.StructField("PercentFat", T.DoubleType(), True),
        T.StructField("PercentProtein", T.DoubleType(), True),
    ]
)

HERD_SCHEMA = T.StructType(
    [
        T.StructField("SourceCode", T.IntegerType(), False),
        T.StructField("SourceHerdID", T.IntegerType(), False),
        T.StructField("LastTestDayEventDate", T.DateType(), True),
    ]
)

# One lactation with a leading row number, and many lactations without animal ID.
SINGLE_LACTATION_CSV = T.StructType(
    [
        T.StructField("row", T.IntegerType(), True),
        T.StructField("LACT", T.IntegerType(), True),
        T.StructField("BDAT", T.DateType(), True),
        T.StructField("FDAT", T.DateType(), True),
        T.StructField("TestDate", T.DateType(), True),
        T.StructField("DIM", T.IntegerType(), True),
        T.StructField("MILK", T.DoubleType(), True),
        T.StructField("PCTF", T.DoubleType(), True),
        T.StructField("PCTP", T.DoubleType(), True),
    ]
)

LACTATIONS_CSV = T.StructType(
    [
        T.StructField("BDAT", T.DateType(), True),
        T.StructField("LACT", T.IntegerType(), True),
        T.StructField("MILK", T.DoubleType(), True),
        T.StructField("DIM", T.IntegerType(), True),
        T.StructField("PCTF", T.DoubleType(), True),
        T.StructField("PCTP", T.DoubleType(), True),
    ]
)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A stored table; ``fmt`` is any format on the cluster (parquet, orc, delta)."""
    return spark.read.format(fmt).load(path)


def read_test_days(
    spark: SparkSession, path: str, fmt: str = "parquet", herd_id: int | None = None
) -> DataFrame:
    """Test-day events with the expected types; the herd filter reaches the scan."""
    events = read_table(spark, path, fmt)
    if herd_id is not None:
        events = events.where(F.col("SourceHerdID") == herd_id)
    return _typed(events, TEST_DAY_SCHEMA)


def read_herds(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _typed(read_table(spark, path, fmt), HERD_SCHEMA)


def _typed(frame: DataFrame, schema: T.StructType) -> DataFrame:
    present = dict(frame.dtypes)
    columns = []
    for field in schema.fields:
        wanted = field.dataType.simpleString()
        column = F.col(field.name)
        columns.append(column if present.get(field.name) == wanted else column.cast(field.dataType).alias(field.name))
    return frame.select(*columns)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header and a given schema, so the file is read once."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_query(spark: SparkSession, text: str, **args) -> DataFrame:
    """A relation named by configured SQL text, with typed parameters."""
    return spark.sql(text, args=args or None)


def name_relation(frame: DataFrame, name: str) -> DataFrame:
    """Give a DataFrame a name for SQL text; nothing is computed."""
    frame.createOrReplaceTempView(name)
    return frame


def rename_test_days(events: DataFrame, animal: str = "ID") -> DataFrame:
    """Stored column names to working names."""
    return events.withColumnsRenamed(
        {
            "MilkWeight": "MILK",
            "PercentFat": "PCTF",
            "PercentProtein": "PCTP",
            "BirthDate": "BDAT",
            "FreshDate": "FDAT",
            "LactationNumber": "LACT",
            "EarTag": animal,
        }
    )


def day_grid(spark: SparkSession, first: int = 0, last: int = 349, step: int = 1) -> DataFrame:
    """Days in milk from first to last as a one-column DataFrame."""
    return spark.range(first, last + 1, step).select(F.col("id").cast("int").alias("DIM"))


def grid_days(first: Column | int = 0, last: Column | int = 349, step: int = 1) -> Column:
    """The same days as an array column, to explode beside each parameter row."""
    low = F.lit(first) if isinstance(first, int) else first
    high = F.lit(last) if isinstance(last, int) else last
    return F.sequence(low.cast("int"), high.cast("int"), F.lit(step))


def write_csv(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("header", True).csv(path)


def write_result(frame: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace a stored result; partitioned by the given columns."""
    writer = frame.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def replace_partitions(frame: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replace the stored partitions that the rows name; all others keep their files.

    ``frame`` must not read from ``path`` itself.
    """
    frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored table, or no rows where nothing has been stored yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def replace_in_table(frame: DataFrame, name: str, by: Sequence[str]) -> DataFrame:
    """Replace those partitions of a catalog table that the rows name, and read it back.

    The table is made at its first use; its partition columns come last.
    """
    spark = frame.sparkSession
    ordered = frame.select(*[c for c in frame.columns if c not in by], *by)
    if spark.catalog.tableExists(name):
        ordered.write.mode("overwrite").insertInto(name)
    else:
        # Kept with the table, so every later overwrite replaces only the partitions it names.
        ordered.write.option("partitionOverwriteMode", "dynamic").partitionBy(*by).saveAsTable(name)
    return spark.table(name)


def save_table(frame: DataFrame, name: str) -> DataFrame:
    """Replace a catalog table by the rows of a DataFrame and read it back."""
    frame.write.mode("overwrite").saveAsTable(name)
    return frame.sparkSession.table(name)


def shared_folder(spark: SparkSession) -> str:
    """A fresh path below the folder the cluster shares for checkpoints.

    A session without one is refused: a local folder would be another one on each machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/lactoscope-{uuid.uuid4().hex}"


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Rows written once to shared storage, so that later jobs start from them."""
    path = shared_folder(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
