"""Session settings, and tables staged in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def session(app: str = "wardline", **conf: str) -> SparkSession:
    return SparkSession.builder.appName(app).config(map=CONF | conf).getOrCreate()


_local: dict[str, str] = {}


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


def fresh_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with the position of each row in the order, from 0. Ranges of the order are numbered in parallel, each from the count of those before."""
    ranged = staged(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = {r["_range"]: r["count"] for r in ranged.groupBy("_range").count().collect()}
    before, offsets = 0, []
    for k in sorted(sizes):
        offsets += [F.lit(k), F.lit(before).cast("long")]
        before += sizes[k]
    if not offsets:
        return ranged.drop("_range").withColumn(name, F.lit(0).cast("long"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn(name, within + F.element_at(F.create_map(*offsets), F.col("_range"))).drop("_range")


def staged(df: DataFrame) -> DataFrame:
    """Written once and reread, so that two uses don't compute it twice and a lost executor loses nothing."""
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
