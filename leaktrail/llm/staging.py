"""Tables written to the shared folder between steps, and removed once the next step has its own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from leaktrail.session import shared_dir


def stage(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` once to the shared folder; the table read back, and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(df: DataFrame, path: str) -> None:
    """Delete a staged table that no later step reads."""
    jvm = df.sparkSession._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def quoted(name: str) -> str:
    """A column's name for ``F.col``, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"
