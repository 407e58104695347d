"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession

# Settings this library relies on or benefits from. UTC is not needed for
# correctness (tables keep TIMESTAMP_NTZ wall clock in UTC) but keeps
# printed instants readable.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # small shuffles feeding CPU-heavy stages (JSON parsing, validation) keep
    # their parallelism; large shuffles are sized by the advisory size anyway
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k",
    # one document is one 15-minute window: many tiny files per scan
    "spark.sql.files.openCostInBytes": str(1 << 20),
    "spark.sql.files.maxPartitionBytes": str(128 << 20),
    "spark.sql.parquet.filterPushdown": "true",
    # a repeated member of a JSON object: the last one counts
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.ui.enabled": "false",
    # no Python call-site capture for every column expression (error-message
    # context only); it costs several JVM round trips per expression built
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "fieldsense", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench; a cluster passes its own."""
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(RECOMMENDED_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting points at shared storage and is used as is; without
    it this raises, because executors cannot see each other's local folders.
    Only a local master (tests, bench) gets a temporary folder, which is removed
    when Python ends.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # a remote (Spark Connect) session has no SparkContext here
        sc = None
    if sc is not None and sc.getCheckpointDir():
        return sc.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and sc is not None:
        configured = sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if sc is None or not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="fieldsense-ckpt-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    if sc is None:
        return configured
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured
