"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app_name: str = "tillcast", master: str | None = None,
                  **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC dates.

    Shuffle width is left to the cluster's own setting: adaptive execution
    merges small partitions and splits skewed ones, so a generous initial
    number is safe. Pass ``spark.sql.shuffle.partitions`` to override.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Keeps streaming state on the executors' disks instead of the heap.
        STATE_STORE: ROCKSDB,
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, whatever the session's own setting.

    A stream takes the settings of the moment it starts. ``transformWithState`` runs on no other
    store, and a session that ``build_session`` has not made comes with Spark's default.
    """
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder on the storage all executors share, deleted when the driver's JVM ends.

    The cluster names that storage in ``spark.checkpoint.dir``. Where that is
    unset, the folder lies below ``spark.sql.warehouse.dir``.
    """
    root = (spark.conf.get("spark.checkpoint.dir", None)
            or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch")
    path = f"{root.rstrip('/')}/tillcast/{label}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(folder)
    return path
