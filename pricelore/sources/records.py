"""JSON files of records: a source of lists or of objects that hold a list, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

#: Version of the form in which raw output is written.
SCHEMA_VERSION = 1


def read_records(spark: SparkSession, path: str, schema: StructType, multi_line: bool = True) -> DataFrame:
    """Records of JSON files that are a list of them, or an object whose `records` is one.

    multi_line=False for files of one object a line, which Spark splits. Objects with an empty list give nothing.
    """
    whole = StructType([*schema.fields, StructField("records", ArrayType(schema))])
    rows = spark.read.schema(whole).option("multiLine", multi_line).json(path)
    one = F.struct(*(F.col(f.name) for f in schema.fields))
    empty = F.coalesce(*(F.col(f.name).cast("string") for f in schema.fields)).isNull() & F.col("records").isNotNull()
    return rows.select(F.explode(F.when(empty, F.col("records")).otherwise(F.array(one))).alias("r")).select("r.*")


def write_records(df: DataFrame, path: str) -> None:
    """One object a line; files appear when the job is committed."""
    df.write.mode("overwrite").json(path)


def write_raw(df: DataFrame, path: str, version: int = SCHEMA_VERSION) -> None:
    """write_records with the version of the form in each record."""
    write_records(df.withColumn("schema_version", F.lit(version)), path)
