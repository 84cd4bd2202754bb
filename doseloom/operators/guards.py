"""Checks of a frame's schema before any job runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import DataType, StructType


def conforms(df: DataFrame, expected: str | StructType) -> DataFrame:
    """``df`` itself if it has the expected fields, else a ``ValueError`` that lists all faults.

    ``expected`` is a schema or its DDL text; a field of type ``void`` may have any
    type. More fields than expected are allowed.
    """
    wanted = expected if isinstance(expected, StructType) else DataType.fromDDL(expected)
    have = {f.name: f.dataType for f in df.schema}
    faults = [f"{f.name} is missing" if f.name not in have else f"{f.name} is {have[f.name].simpleString()}, "
              f"not {f.dataType.simpleString()}" for f in wanted
              if f.name not in have or f.dataType.typeName() != "void" and have[f.name] != f.dataType]
    if faults:
        raise ValueError("unfit columns: " + "; ".join(faults))
    return df
