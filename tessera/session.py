"""Session construction and lineage checkpoints.

On a cluster the session is created by the platform; ``get_spark`` is for
tests, local runs and ``bench.py``.  Cluster-wide settings (AQE, skew join,
UTC session time zone) are applied with ``setdefault`` semantics: a value the
cluster already set is never overridden.
"""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every plan in this package assumes.  They are only applied when
# the session does not already carry a value.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    # joins of a selective side (search hits, candidate ids) with a huge one
    # (the corpus) get a runtime bloom filter on the huge side before its shuffle
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app_name: str = "tessera") -> SparkSession:
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply DEFAULT_CONF where unset, make sure a checkpoint dir exists and
    ship this package to the Python workers."""
    for k, v in DEFAULT_CONF.items():
        if spark.conf.get(k, None) in (None, ""):
            spark.conf.set(k, v)
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tessera`` importable in Python workers (the functions given to
    ``applyInPandasWithState`` / ``mapInPandas`` live in it), whatever the
    driver's working directory: the runtime form of ``--py-files``.  Skipped
    when the package is installed on the workers already (then nothing is
    needed) -- detected by the application having shipped it once."""
    try:
        sc = spark.sparkContext
        app = sc.applicationId
    except Exception:  # noqa: BLE001 - no SparkContext view: rely on the install
        return
    if app in _SHIPPED:
        return
    import shutil
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="tessera-pyfiles-")
    archive = shutil.make_archive(os.path.join(out, "tessera"), "zip",
                                  root_dir=os.path.dirname(pkg_dir), base_dir=os.path.basename(pkg_dir))
    sc.addPyFile(archive)
    _SHIPPED.add(app)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set by the platform to shared storage.  Only
    when it is unset (local tests) do we create a private scratch folder;
    it is registered with ``SparkContext.setCheckpointDir`` (the conf itself
    cannot be changed at run time).  On a cluster such a folder would lie on
    one machine only, so there an unset folder is an error.
    """
    sc = spark.sparkContext
    d = (spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
         or _LOCAL_CKPT.get(sc.applicationId))
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="tessera-ckpt-")
        _LOCAL_CKPT[sc.applicationId] = d
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


_LOCAL_CKPT: dict[str, str] = {}


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet under the shared checkpoint folder and read it
    back: cuts lineage (an executor loss re-reads files instead of
    recomputing upstream stages) and lets several branches share one
    computation, with exact file-size statistics for AQE."""
    import uuid
    base = checkpoint_dir(df.sparkSession).rstrip("/")
    if "://" not in base and not base.startswith("/"):
        base = os.path.abspath(base)
    path = f"{base}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
