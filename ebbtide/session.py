"""Session set-up and stage tables.

A stage table is a Parquet copy of an intermediate result in the shared folder named by
``spark.checkpoint.dir``. It cuts lineage, survives lost executors and, unlike a cached frame,
keeps column pruning, filter push-down and true size statistics for whoever reads it next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "ebbtide", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**SESSION_CONF, **(conf or {})}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, else the context's checkpoint folder, else one beside the warehouse's tables."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stage"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root.rstrip("/")


def stage_root(spark: SparkSession) -> str:
    """Folder of this application's stage tables."""
    return f"{shared_folder(spark)}/ebbtide/{spark.sparkContext.applicationId}"


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a stage table and return the frame that reads it back."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(staged: DataFrame) -> None:
    """Delete the folder of a stage table that nothing will read again."""
    spark = staged.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in staged.inputFiles()}:
        if f"/ebbtide/{spark.sparkContext.applicationId}/" not in folder:
            raise ValueError(f"{folder} is not a stage table")
        _delete(spark, folder)


def clear_stages(spark: SparkSession) -> None:
    """Delete all stage tables of this application, at its end."""
    _delete(spark, stage_root(spark))
