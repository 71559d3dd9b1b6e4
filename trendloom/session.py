"""Session settings and the reliable checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

# Settings that hold on a laptop and on a cluster alike. Partition counts are left to AQE, which
# starts from spark.sql.shuffle.partitions and coalesces, and splits skewed join partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even where that costs one more shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # hash instead of sort where every shuffled partition of the build side is measured to be small
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster job brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("trendloom")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a folder of its own; on a cluster a missing
    setting is an error, since a folder on one machine would be lost with that machine.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if folder:
        if not current:
            sc.setCheckpointDir(folder)
        return folder
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="trendloom-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def path_exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def work_folder(spark: SparkSession) -> str:
    """A new folder on shared storage for files that a job lands and reads again."""
    return f"{checkpoint_dir(spark)}/work/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back.

    Lost executors then cost no long replay, and the known file size lets Spark choose a broadcast only
    where the written table is small.
    """
    return cut_and_measure(df)[0]


def _table_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"


def settle_batch(df: DataFrame, spark: SparkSession) -> DataFrame:
    """A micro-batch as a written table of the session ``spark``.

    Spark switches adaptive execution off in the session of a stream; work on the written batch has it,
    and with it the splitting of hot keys. The batch's source is read once.
    """
    folder = _table_folder(spark)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def cut_and_measure(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """As ``cut``, with aggregates of the rows gathered by the same write."""
    spark = df.sparkSession
    folder = _table_folder(spark)
    watch = Observation()
    rows = df.observe(watch, *[c.alias(n) for n, c in metrics.items()]) if metrics else df
    rows.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder), watch.get if metrics else {}
