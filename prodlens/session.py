"""Session helpers.

A cluster names its shared checkpoint folder in ``spark.checkpoint.dir``;
we read it from the session and only fall back to a fresh local folder when
the setting is absent (local runs and tests).
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "prodlens") -> SparkSession:
    """A local session with the settings the library assumes."""
    master = master or "local[%s]" % os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", os.environ.get("PRODLENS_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's shared checkpoint folder.

    ``spark.checkpoint.dir`` is honoured when the cluster sets it. Only when
    it is unset (local runs, tests) do we create a folder of our own.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # a session without a local context (Spark Connect):
        return spark.conf.get("spark.checkpoint.dir", None)  # the server's setting applies
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster; "
                               "a machine-local folder does not survive executor loss")
        conf_dir = tempfile.mkdtemp(prefix="prodlens-ckpt-")  # local runs and tests only
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Queries that run inside take Arrow batches of at most ``most`` rows, for
    wide rows: Spark fills batches by rows, in the JVM and in Python. Their
    shuffle files go when they end."""
    held = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(most),
            "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    was = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write_table(df: DataFrame) -> DataFrame:
    """Write ``df`` as parquet into a fresh folder under the shared
    checkpoint folder and read it back: lineage is cut, the data survives
    executor loss, and later reads are columnar with column pruning and
    filter pushdown (unlike an RDD checkpoint)."""
    import uuid
    base = ensure_checkpoint_dir(df.sparkSession)
    if not base:
        return df.checkpoint(eager=True)
    path = "%s/prodlens-tables/%s" % (base.rstrip("/"), uuid.uuid4().hex)
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.parquet(path)


def cluster_conf(input_tb: float, executor_cores: int = 4,
                 target_partition_mb: int = 256) -> dict[str, str]:
    """Settings for a cluster run over ``input_tb`` terabytes of input.

    File splits are ``target_partition_mb`` so a task's input fits in
    executor memory. Shuffled volume is well below the input after
    map-side aggregation (term counts, class counts), so reduce partitions
    are sized for an eighth of the input at the same partition size and
    capped at 50,000 (map tasks x reduce partitions is the number of
    shuffle blocks); AQE then coalesces small partitions and splits skewed
    ones by measured size. 100 TB at 256 MB gives 50,000.
    """
    mb = target_partition_mb
    partitions = min(50_000, max(200, int(input_tb * 1024 * 1024 / (8 * mb))))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "%dm" % mb,
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "%dm" % (mb * 2),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": "%dm" % mb,
        "spark.sql.autoBroadcastJoinThreshold": "64m",
        "spark.sql.session.timeZone": "UTC",
        "spark.executor.cores": str(executor_cores),
        "spark.ui.enabled": "false",
    }
