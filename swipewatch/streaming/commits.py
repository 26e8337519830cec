"""One commit for all outputs of a micro-batch.

A batch writes each output into a folder of its own attempt, and one small file, put in place by a rename when all are
there, says which attempt counts. Readers follow these files: they see a batch in all of its outputs or in none, and
nothing of attempts that failed. A batch that has its file is never written again, so there is no moment at which
something that was visible is missing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from swipewatch.sources import tables

COMMIT = "batch_id long, attempt string"


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    return hadoop, where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _commit_path(folder: str, batch_id: int) -> str:
    return tables.join_path(folder, "commits", f"{batch_id}.json")


def is_committed(spark: SparkSession, folder: str, batch_id: int) -> bool:
    _, where, files = _file_system(spark, _commit_path(folder, batch_id))
    return files.exists(where)


def commit(spark: SparkSession, folder: str, batch_id: int, attempt: str) -> None:
    """Makes the attempt's outputs visible, all at once."""
    hadoop, where, files = _file_system(spark, _commit_path(folder, batch_id))
    draft = hadoop.Path(tables.join_path(folder, "commits", f"_{batch_id}-{attempt}"))
    out = files.create(draft, True)
    out.write(bytearray(json.dumps({"batch_id": batch_id, "attempt": attempt}).encode()))
    out.close()
    if not files.rename(draft, where):
        raise OSError(f"could not commit batch {batch_id}")


def write_batch(batch: DataFrame, batch_id: int, folder: str, outputs: Callable[[Callable[[str, DataFrame], DataFrame]], None]) -> None:
    """Runs ``outputs(store)`` and commits what it stored. ``store(name, rows)`` writes one output and gives it back as
    stored, so that outputs can be made from one another and cannot disagree."""
    spark, attempt = batch.sparkSession, uuid.uuid4().hex
    if is_committed(spark, folder, batch_id):
        # its results stand; only the state has to come to the same point
        batch.write.format("noop").mode("overwrite").save()
        return

    def store(name: str, rows: DataFrame) -> DataFrame:
        target = tables.join_path(folder, name, f"batch_id={batch_id}", f"attempt={attempt}")
        rows.write.mode("overwrite").parquet(target)
        return spark.read.schema(rows.schema).parquet(target)

    outputs(store)
    commit(spark, folder, batch_id, attempt)


def read_output(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """An output of a stream under ``folder``: rows of committed batches."""
    counted = spark.read.schema(COMMIT).json(tables.join_path(folder, "commits"))
    rows = spark.read.parquet(tables.join_path(folder, name))
    return rows.join(counted, ["batch_id", "attempt"], "left_semi").drop("batch_id", "attempt")
