"""Session and lineage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "relaytrace", master: str | None = None,
                shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session or build one tuned for this workload.

    On a cluster the master and most settings come from the submitter; the
    values below only fill gaps: a setting that was submitted stays.  AQE stays
    on so that partition counts coalesce at runtime and skewed joins split.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    spark = b.getOrCreate()
    fill = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true",
            "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC",
            "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.variant.allowDuplicateKeys": "true"}
    if shuffle_partitions is not None:
        fill["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    given = spark.sparkContext.getConf()
    for key, value in fill.items():
        if not given.contains(key):
            spark.conf.set(key, value)
    return spark


_PRIVATE: dict[str, str] = {}  # private checkpoint folder of a local application


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``, with its scheme.

    On a cluster this must be a shared file system; it is read from the
    session.  Only in local mode, where driver and executors are one process,
    a private folder is made when it is unset; elsewhere that is an error.

    A path without a scheme is of the default file system, as Spark reads it;
    given with its scheme, every library finds the same place.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or _PRIVATE.get(sc.applicationId)
    if not d:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder on a shared file system")
        d = _PRIVATE[sc.applicationId] = "file:" + tempfile.mkdtemp(prefix="relaytrace-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    path = spark._jvm.org.apache.hadoop.fs.Path(d)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder (never machine-local)."""
    base = checkpoint_dir(spark).rstrip("/")
    path = f"{base}/relaytrace-{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append(path)
    return path


def drop_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables this process wrote (any Hadoop file system),
    and what ``cut_lineage`` checkpointed.

    Frames returned by the plans read these tables lazily, so call this only
    after the outputs are written.  Returns the number of folders removed.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    n = 0
    while _SCRATCH:
        path = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        if path.getFileSystem(conf).delete(path, True):
            n += 1
    if (own := spark.sparkContext.getCheckpointDir()) is not None:  # this application's folder
        path = jvm.org.apache.hadoop.fs.Path(own)
        fs = path.getFileSystem(conf)
        for kept in fs.listStatus(path) if fs.exists(path) else []:
            if kept.getPath().getName().startswith("rdd-") and fs.delete(kept.getPath(), True):
                n += 1
    return n


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably (survives executor loss) and cut lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``relaytrace`` importable in Python workers (``--py-files`` style).

    Zips the installed package once per SparkContext and adds it with
    ``addPyFile``; Spark distributes it to every executor.
    """
    sc = spark.sparkContext
    if id(sc) in _SHIPPED:
        return
    import shutil

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = tempfile.mkdtemp(prefix="relaytrace-pyfiles-")
    archive = shutil.make_archive(os.path.join(out, "relaytrace"), "zip", root_dir=root, base_dir="relaytrace")
    sc.addPyFile(archive)
    _SHIPPED.add(id(sc))
