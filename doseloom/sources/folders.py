"""A folder of text for each value of a column, where these are as many as samples.

On a local or mounted store Spark's partitioned writer starts two ``chmod`` processes for every file, and the
driver moves the folders one by one. There the tasks write the files of their own rows, in the same folders. On other
stores Spark's writer and reader are used.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doseloom.plans import storage

NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
_SPECIAL = re.compile(r"[\x01-\x1f\x7f\"#%'*/:=?\\{\[\]^]")
_LINES = pa.schema([("s", pa.string()), ("value", pa.string())])
_READ_CHARACTERS = 1 << 20


def folder_name(column: str, value: str | None) -> str:
    """The folder's name as Spark writes and reads it."""
    return f"{column}=" + (_SPECIAL.sub(lambda m: f"%{ord(m[0]):02X}", value) if value else NO_VALUE)


def write_lines(ordered: DataFrame, uri: str) -> str:
    """The ``line``s of the rows as text files in a folder for each value of the other column; what was there goes.

    Rows stay in the order of their partition. A task writes a file for each run of rows of one folder, numbered by its
    partition and the run and renamed when it is whole, so a task that runs again replaces its own files.
    """
    spark = ordered.sparkSession
    column, = (c for c in ordered.columns if c != "line")
    root = storage.local_path(spark, uri)
    if root is None:
        ordered.write.mode("overwrite").partitionBy(column).text(uri)
        return uri
    storage.empty_folder(spark, uri)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        aside = f".part-{part:05d}-{uuid.uuid4().hex}"
        now, folder, out, files = None, "", None, 0

        def close() -> None:
            out.close()
            os.replace(f"{folder}/{aside}", f"{folder}/part-{part:05d}-{files:07d}.txt")

        for batch in batches:
            for value, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if out is None or value != now:
                    if out is not None:
                        close()
                    now, folder, files = value, f"{root}/{folder_name(column, value)}", files + 1
                    os.makedirs(folder, exist_ok=True)
                    out = open(f"{folder}/{aside}", "wb")
                out.write((line or "").encode() + b"\n")
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], ["files"])

    named = ordered.select(F.col(column).cast("string").alias("value"), "line")
    named.mapInArrow(written, "files long").collect()  # one number a task
    storage.mark_whole(spark, uri)
    return uri


def read_lines(spark: SparkSession, uri: str, column: str, values: DataFrame) -> DataFrame:
    """``column, value``: the lines in the folders of these values of one column; a value without a folder has none.

    The driver lists nothing: each task looks into the folders of the values that are dealt to it.
    """
    wanted = values.select(F.col(column).cast("string").alias(column))
    root = storage.local_path(spark, uri)
    if root is None:
        lines = spark.read.schema(f"value string, {column} string").text(uri)
        wanted = wanted.select(F.nullif(F.col(column), F.lit("")).alias("_wanted")).distinct()
        return lines.join(wanted, F.col(column).eqNullSafe(F.col("_wanted")), "left_semi").select(column, "value")
    tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str | None] = []
        lines: list[str] = []
        size = 0

        def filled() -> pa.RecordBatch:
            nonlocal size
            rows = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(lines, pa.string())], schema=_LINES)
            names.clear(), lines.clear()
            size = 0
            return rows

        for batch in batches:
            for value in batch.column(0).to_pylist():
                folder = f"{root}/{folder_name(column, value)}"
                files = sorted(os.listdir(folder)) if os.path.isdir(folder) else []
                for file in files:
                    if file[0] in "._":
                        continue
                    with open(f"{folder}/{file}", encoding="utf-8", errors="replace") as text:
                        for line in text:
                            names.append(value)
                            lines.append(line.removesuffix("\n"))
                            size += len(line)
                            if size >= _READ_CHARACTERS:
                                yield filled()
            if names:
                yield filled()

    wanted = wanted.select(F.nullif(F.col(column), F.lit("")).alias(column)).repartition(tasks, column).distinct()
    return wanted.mapInArrow(read, "s string, value string").select(F.col("s").alias(column), "value")
