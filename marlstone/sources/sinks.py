"""Sinks: partitions replaced, keyed upserts, append logs, and sources with a fallback."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marlstone.session import scratch


def write_partitions(df: DataFrame, path: str, by: str) -> None:
    """Write df partitioned by a column; partitions that df has are replaced, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def replaced(old: DataFrame, new: DataFrame, by: str) -> DataFrame:
    """old written to the shared folder, then the partitions of new written over it, read back."""
    path = scratch(old.sparkSession, "partitions")
    write_partitions(old, path, by)
    write_partitions(new.select(*old.columns), path, by)
    fields = StructType([f for c in (*[c for c in old.columns if c != by], by) for f in old.schema if f.name == c])
    return old.sparkSession.read.schema(fields).parquet(path).select(*old.columns)


def read_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of whole-array JSON files, by a declared schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def first_filled(sources: Iterable[DataFrame | None]) -> DataFrame:
    """The first source with a row; the last one if none has. One row of each is looked at."""
    last = None
    for df in sources:
        if df is not None:
            last = df
            if not df.isEmpty():
                return df
    if last is None:
        raise ValueError("no source is given")
    return last


def scoped_ids(chunks: DataFrame, base: str = "base") -> DataFrame:
    """chunks with ids that hold their corpus, but for the base corpus, prefixed once."""
    spec = F.lower(F.trim(F.coalesce("spec", F.lit(base))))
    spec = F.when(spec == "", base).otherwise(spec)
    prefixed = F.concat_ws(":", spec, "id")
    return chunks.withColumn("id", F.when((spec == base) | F.col("id").startswith(F.concat(spec, F.lit(":"))), F.col("id")).otherwise(prefixed)).withColumn("spec", spec)
