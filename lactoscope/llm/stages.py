"""Stored stages and Arrow batch sizes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lactoscope.sources.tables import cut_lineage

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows for the jobs run inside, whose rows are large."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def stored(frame: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """Rows written once to the shared folder and read from there by all later steps."""
    if batch_rows is None:
        return cut_lineage(frame)
    with batches_of(frame.sparkSession, batch_rows):
        return cut_lineage(frame)


def discard(*stages: DataFrame) -> None:
    """Delete the folders of stored stages, once all that reads them is stored itself."""
    for stage in stages:
        session = stage.sparkSession
        jvm = session.sparkContext._jvm
        for folder in {f.rsplit("/", 1)[0] for f in stage.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            if not path.getName().startswith("lactoscope-"):
                raise ValueError(f"{folder} is no stored stage")
            path.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@dataclass(frozen=True)
class Shielded:
    """Rows whose columns have names that operators do not use inside."""

    rows: DataFrame
    names: dict[str, str]

    def restored(self, frame: DataFrame) -> DataFrame:
        """The same columns of a frame under their own names and in their own order."""
        return frame.select(*[F.col(inside).alias(name) for name, inside in self.names.items()])


def shielded(docs: DataFrame, known: Sequence[str] = ("doc_id", "text", "n_chars")) -> Shielded:
    """Columns that an operator only hands on get names of their own while it works."""
    names = {c: c if c in known else f"handed_on_{i}_" for i, c in enumerate(docs.columns)}
    return Shielded(docs.select(*[F.col(f"`{c}`").alias(inside) for c, inside in names.items()]), names)


def numbered(docs: DataFrame, name: str = "row_number_") -> DataFrame:
    """Rows of a stored table with a number each, the same on every scan of it.

    Keys of the data may be null or repeated; this one is neither. It is made of the file's
    place among the table's files by name, of which the driver has a list for every scan in
    any case, and of the row's place in the file, which Parquet scans give however a file is
    split. Rows from anywhere else are stored once with their numbers. Columns of ``docs``
    may have any name but ``name``.
    """
    own = uuid.uuid4().hex
    file, place, nth = (f"{part}_{own}" for part in ("file", "place", "nth"))
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(place))
        placed.schema  # fails without these columns
    except AnalysisException:
        return stored(docs.withColumn(name, F.monotonically_increasing_id()))
    files = sorted(r[0] for r in placed.select(file).distinct().collect())
    if not files:
        return docs.withColumn(name, F.monotonically_increasing_id())
    numbers = docs.sparkSession.createDataFrame(list(enumerate(files)), f"{nth} long, {file} string")
    number = F.shiftleft(nth, 40) + F.col(place)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return placed.join(F.broadcast(numbers), file).select(*columns, number.alias(name))
