"""Session defaults and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "mailspark", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # messages can be tens of MB: keep Arrow batches short
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder path every executor can reach.

    Uses the cluster's ``spark.checkpoint.dir``, or the checkpoint folder that
    the application has set. Only a local session (tests, one machine) may
    have neither; it gets a temporary folder. A cluster without one is an
    error: its executors would each write to their own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="mailspark-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def arrow_uri(spark: SparkSession, path: str) -> str:
    """The path as Spark resolves it, spelled for Arrow's file systems."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    uri = fs.makeQualified(hadoop_path).toString()
    if uri.startswith("file:/") and not uri.startswith("file://"):
        return uri[len("file:"):]      # a local path, taken as it is
    return uri.replace("s3a://", "s3://", 1)


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` once to ``path`` and read it back.

    Cuts lineage for frames that feed several outputs; unlike a cache the
    copy survives lost executors. The caller drops it with :func:`drop_path`.
    """
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a staging folder of the job's own."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt over ``spark.mailspark.spread`` tasks where the caller has
    set that (few, unsplittable input files); else as it is."""
    tasks = df.sparkSession.conf.get("spark.mailspark.spread", None)
    return df.repartition(int(tasks), key) if tasks else df
