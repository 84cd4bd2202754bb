"""Tables between the steps of an operator, and the number of buckets rows are dealt to."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doseloom.plans.storage import new_folder


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write a step's rows below ``spark.checkpoint.dir`` and read them back.

    Later steps read files that every executor reaches, so a lost executor costs
    no recomputation and each row has one value however often it is read.
    """
    uri = new_folder(df.sparkSession, label)
    schema = df.schema
    df.write.parquet(uri)
    return df.sparkSession.read.schema(schema).parquet(uri)


def buckets(spark: SparkSession, per_partition: int = 4) -> int:
    """How many buckets packed keys are dealt to: some for each shuffle partition.

    ``spark.sql.shuffle.partitions`` is what a cluster sizes with its input, so a
    bucket keeps its size as the input grows.
    """
    return max(8, per_partition * int(spark.conf.get("spark.sql.shuffle.partitions")))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like the wanted ones that ``df`` doesn't have, in any letter case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def whole_text(name: str = "text") -> Column:
    """The text as a string; null is the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_rows(docs: DataFrame) -> DataFrame:
    """``doc_id`` and whole text only: other columns, whatever their names, stay out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def crc_of(ids: np.ndarray) -> int:
    """crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def as_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
