"""Schema snapshots: captured from what is there, saved as JSON lines, and loaded again."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMNS = "dataset_urn string, ordinal int, name string, native_type string, data_type string, nullable boolean"


def logical(kind: T.DataType) -> str:
    """The catalog's five logical types."""
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, T.DateType):
        return "date"
    return "time" if isinstance(kind, T.TimestampType | T.TimestampNTZType) else "string"


def live_columns(spark: SparkSession, frames: dict[str, DataFrame | None]) -> DataFrame:
    """Catalog columns of tables by urn, from their schemas alone; a table that isn't there (None) has none."""
    rows = [
        (urn, i, f.name, f.dataType.simpleString(), logical(f.dataType), f.nullable)
        for urn, frame in frames.items()
        if frame is not None
        for i, f in enumerate(frame.schema.fields, 1)
    ]
    return spark.createDataFrame(rows, COLUMNS)


def capture(catalog: DataFrame, discovered: DataFrame, known: DataFrame) -> DataFrame:
    """The catalog's columns of discovered and known datasets (dataset_urn each); those without a schema are left out."""
    wanted = discovered.select("dataset_urn").union(known.select("dataset_urn")).where("dataset_urn is not null").distinct()
    return catalog.join(wanted, "dataset_urn", "left_semi")


def save(columns: DataFrame, path: str) -> None:
    """Writes a snapshot in place of an earlier one."""
    columns.write.mode("overwrite").json(path)


def load(spark: SparkSession, path: str, schema: str = COLUMNS) -> DataFrame:
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no snapshot in {path}; save one of the baseline first") from error


def spark_type(native: Column) -> Column:
    """Native types as Spark writes them."""
    kind = F.lower(native)
    return F.when(kind.startswith("number"), F.concat(F.lit("decimal"), F.regexp_extract(kind, r"\(.*\)", 0))).when(kind.startswith("varchar"), "string").otherwise(kind)
