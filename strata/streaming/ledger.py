"""Tables that streams add to once: a folder for each batch of each source, and a ledger of the batches that are whole.

A batch that is tried again after a crash writes its folder anew, so half a batch never stays beside a whole one. Readers
see the batches in the ledger only, and no batch reads what others have written.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

C = F.col
ENTRY = "source string, batch long, n_rows long"
Emit = Callable[[DataFrame, int], None]


def _read(spark: SparkSession, schema: T.StructType | str, path: str, base: str) -> DataFrame | None:
    """Parquet with a stated schema, so that no file has to be there to infer it; None where there is no such folder."""
    try:
        return spark.read.schema(schema).option("basePath", base).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def is_committed(spark: SparkSession, path: str, source: str, batch: int) -> bool:
    entry = _read(spark, ENTRY, f"{path}/ledger/source={source}/batch={batch}", f"{path}/ledger")
    return entry is not None and not entry.isEmpty()


def write_rows(rows: DataFrame, path: str, source: str, batch: int) -> None:
    """First half of a commit: the batch's folder, in place of what an earlier try has left in it."""
    rows.write.mode("overwrite").parquet(f"{path}/rows/source={source}/batch={batch}")


def enter(spark: SparkSession, path: str, source: str, batch: int, n_rows: int) -> None:
    """Second half: from now on readers see the batch."""
    spark.createDataFrame([(n_rows,)], "n_rows long").coalesce(1).write.mode("overwrite").parquet(f"{path}/ledger/source={source}/batch={batch}")


def write_batch(rows: DataFrame, path: str, source: str, batch: int) -> bool:
    """Add a batch unless the ledger has it; says whether it was added. An empty batch is a batch too."""
    spark = rows.sparkSession
    if is_committed(spark, path, source, batch):
        return False
    write_rows(rows, path, source, batch)
    stored = _read(spark, rows.schema, f"{path}/rows/source={source}/batch={batch}", f"{path}/rows")
    enter(spark, path, source, batch, stored.count())
    return True


def committed(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of all whole batches, with `source` and `batch`; no rows while there is no table."""
    kinds = spark.createDataFrame([], schema).schema
    where = [T.StructField("source", T.StringType()), T.StructField("batch", T.LongType())]
    full = T.StructType([*kinds.fields, *where])
    rows = _read(spark, full, f"{path}/rows", f"{path}/rows")
    entries = _read(spark, ENTRY, f"{path}/ledger", f"{path}/ledger")
    if rows is None or entries is None:
        return spark.createDataFrame([], full)
    return rows.join(entries.select("source", "batch"), ["source", "batch"], "left_semi").select(*[f.name for f in full.fields])


def once_each(rows: DataFrame, key: str) -> DataFrame:
    """The first row of each key, should two sources have written it."""
    return rows.groupBy(key).agg(F.min_by(F.struct("*"), F.struct("batch", "source")).alias("r")).select("r.*")


def sink(path: str, source: str, emit: Sequence[Emit] = (), prepare: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that commits each batch and then shows it to the `emit` callbacks, which are not called for a batch that is in the ledger."""

    def write(rows: DataFrame, batch: int) -> None:
        rows = rows if prepare is None else prepare(rows)
        if write_batch(rows, path, source, batch):
            for call in emit:
                call(committed(rows.sparkSession, path, rows.schema).filter((C("source") == source) & (C("batch") == batch)).drop("source", "batch"), batch)

    return write
