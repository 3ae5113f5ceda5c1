"""What the operators share: reading, staging in the shared folder, and Arrow maps over texts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import textvec


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_local: dict[str, str] = {}
_scopes: list[list[tuple[SparkSession, str]]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset a session on one machine has a temporary one; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _local:
        _local[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="wardline-")
    return _local[context.applicationId]


def staged(df: DataFrame, name: str, scopes: list | None = None) -> DataFrame:
    """The frame, written to the shared folder and reread: its lineage ends at files that outlive any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for scope in _scopes[-1:] if scopes is None else scopes:
        scope.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """The frame that build returns, staged; whatever build staged on the way is deleted."""
    inner: list[tuple[SparkSession, str]] = []
    _scopes.append(inner)
    try:
        return staged(build(), name, _scopes[-2:-1])
    finally:
        _scopes.pop()
        for spark, path in inner:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def id_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Just the two columns, so that no other column of the input can clash or be read."""
    return docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that the frame doesn't have, however cases are compared."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def map_steps(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str = "text", step_bytes: int = textvec.STEP_BYTES) -> DataFrame:
    """fn over pieces of each partition that hold a bounded amount of text."""
    textvec.tune(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in textvec.steps(batches, column, step_bytes):
            out = fn(step)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)
