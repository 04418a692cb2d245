"""Session construction and the shared working folder.

Everything that must outlive a task (checkpoints, written intermediate
tables, sink outputs of the catalogue queries) goes below the folder the
cluster names in ``spark.checkpoint.dir``.  We only pick our own folder
when the session has none, which is the case in local tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "sylvan", extra: dict | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(master).appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        # list up to this many folders on the driver instead of launching a
        # listing job (per-run log folders number in the thousands)
        .config("spark.sql.sources.parallelPartitionDiscovery.threshold", "8192")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide folder for checkpoints and written tables.

    Read from the session (``spark.checkpoint.dir`` or the context's
    checkpoint folder).  Only when neither is set and the master is local
    (tests) a fresh folder is created and registered, so later calls agree;
    on a cluster an unset folder is an error, never a machine-local guess.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local"):
            # a machine-local folder would not be shared by the executors
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach "
                               "(HDFS, object store or a shared mount)")
        d = tempfile.mkdtemp(prefix="sylvan-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path below the shared folder (never reused)."""
    base = shared_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    return os.path.join(base, "sylvan", f"{name}-{uuid.uuid4().hex[:12]}")


def cluster_conf(input_bytes: int, total_cores: int,
                 shuffle_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings for a large cluster, sized from the input and the slots.

    * scan splits of 512 MB: 100 TB gives ~200k scan tasks;
    * shuffle partitions so one holds ~256 MB of shuffled rows (AQE
      coalesces smaller ones and splits skewed ones);
    * Arrow batches of 10k rows for the vectorised plan (rows x trees of
      node indexes per batch stay within a few hundred MB for 1,600 trees).
    """
    parts = max(2 * total_cores, int(input_bytes // shuffle_partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(512 << 20),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(shuffle_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
        "spark.sql.session.timeZone": "UTC",
    }


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``sylvan`` importable in the Python workers (once per context).

    Plans with Python closures (mapInPandas, pandas UDFs) unpickle
    ``sylvan`` functions on the executors; the package is zipped on the
    driver and handed to ``addPyFile``, which Spark distributes to every
    executor -- the programmatic form of ``--py-files``.
    """
    sc = spark.sparkContext
    ident = sc.applicationId
    if ident in _SHIPPED:
        return
    import shutil
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="sylvan-pyfiles-")
    archive = shutil.make_archive(os.path.join(out, "sylvan"), "zip",
                                  root_dir=os.path.dirname(pkg_dir), base_dir="sylvan")
    sc.addPyFile(archive)
    _SHIPPED.add(ident)
