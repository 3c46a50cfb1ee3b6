"""Session construction and shared scratch locations.

Everything that has to be written in the middle of a job (CSV round trips, the scored
table) goes under the folder the cluster names in ``spark.checkpoint.dir``. That folder is
read from the session; only when it is unset (a laptop, a test) is a local one created.
"""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
# Masters that run everything in one process; local-cluster[...] has executors of its own.
LOCAL_MASTER = re.compile(r"local(\[(\*|\d+)(\s*,\s*\d+)?\])?")


def build_session(master: str | None = None, app_name: str = "babelscore",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Session with the settings the jobs rely on.

    On a cluster ``master`` stays ``None`` (spark-submit decides) and the shuffle partition
    count is left to AQE's coalescing; locally the caller passes ``local[n]``.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    prepare(spark)
    return spark


def _context(spark: SparkSession):
    """The SparkContext of a classic session; None on a Spark Connect session."""
    try:
        return spark.sparkContext
    except Exception:  # Spark Connect sessions have no SparkContext
        return None


def default_parallelism(spark: SparkSession) -> int:
    sc = _context(spark)
    if sc is not None:
        return sc.defaultParallelism
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application.

    Model UDFs are pickled with references to this package; workers started outside the
    package's folder (a cluster, or a driver started from elsewhere) could not import it. The
    package is zipped (sources only) and added with ``addPyFile``, which serves it to every
    executor and puts it on the workers' path, as ``spark-submit --py-files`` would."""
    sc = _context(spark)
    if sc is None or sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(pkg):  # imported from a zip: already shipped (--py-files)
        return
    # A unique name: a --py-files archive called babelscore.zip may already be registered.
    out = os.path.join(tempfile.mkdtemp(prefix="babelscore-pyfiles-"),
                       f"babelscore-{uuid.uuid4().hex[:12]}.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, dirs, files in os.walk(pkg):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)


def prepare(spark: SparkSession) -> str:
    """Everything a job needs from its session: the shared checkpoint folder and this package
    on the Python workers. Returns the checkpoint folder."""
    path = ensure_checkpoint_dir(spark)
    ship_package(spark)
    return path


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder. Only a local session without one gets a local
    folder; a cluster session without one is an error."""
    sc = _context(spark)
    path = spark.conf.get(CHECKPOINT_CONF, None)
    if not path and sc is not None:
        path = sc.getCheckpointDir()
    if not path:
        master = sc.master if sc is not None else spark.conf.get("spark.master", "")
        if not LOCAL_MASTER.fullmatch(master):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder every executor can reach; "
                             "a machine-local folder does not work on a cluster")
        # Unset on a local session (tests, one machine): a local folder is right.
        path = tempfile.mkdtemp(prefix="babelscore-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, path)
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused sub-folder of the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    sc = _context(spark)
    app = sc.applicationId if sc is not None else "connect"
    root = f"{base}/babelscore-scratch/{app}"
    if sc is not None and root not in _ROOTS:
        _ROOTS[root] = sc
        atexit.register(remove_scratch, root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


_ROOTS: dict[str, object] = {}


def remove_scratch(root: str) -> None:
    """Delete an application's scratch tables; run when the driver ends, while its session lives.
    Only the folder that this application made under the shared checkpoint folder goes."""
    sc = _ROOTS.pop(root, None)
    if sc is None or getattr(sc, "_jsc", None) is None:  # already stopped
        return
    try:
        path = sc._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM is gone; what is left lies in the checkpoint folder
        return


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
